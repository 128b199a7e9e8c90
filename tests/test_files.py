"""A folder of files of several kinds becomes block rows in one query; bad files are rows with an error."""

from lexstrata.sources import files


def test_a_folder_of_files(spark, tmp_path):
    put = lambda name, content: (tmp_path / name).parent.mkdir(parents=True, exist_ok=True) or (tmp_path / name).write_bytes(content)
    put("a.csv", "﻿name,note\r\n\r\n\"x, \"\"y\"\"\",1\r\nz\r\n".encode())
    put("sub/b.CSV", b"k\n1\n2\n")
    put("c.md", b"# Title\n\ntext\n\n- one\n- two\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n")
    put("d.html", "<html><head><title>T</title><style>x{}</style></head><body><h2>A &amp; B &#8212; &#x4e2d;</h2><p>p<br>q</p><ul><li>i</li><li>j</li></ul><table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td></td></tr></table>tail</body></html>".encode())
    put("e.txt", b"one\nline\n\n\ntwo\n")
    put("bad.csv", b"\xff\xfe\x00x")
    put("f.xyz", b"?")
    put("empty.md", b"")
    found = files.file_blocks(files.scanned(spark, str(tmp_path)))
    got = {}
    for r in found.collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    kinds = {name: [r["kind"] for r in sorted(rows, key=lambda r: r["block_index"] or 0)] for name, rows in got.items()}
    assert kinds == {"a.csv": ["table"], "b.CSV": ["table"], "c.md": ["heading", "paragraph", "list", "table"], "d.html": ["paragraph", "heading", "paragraph", "paragraph", "list", "table", "paragraph"], "e.txt": ["paragraph", "paragraph"], "bad.csv": [None], "f.xyz": [None]}
    assert got["a.csv"][0]["headers"] == ["name", "note"] and got["a.csv"][0]["rows"] == [['x, "y"', "1"], ["z", ""]]
    assert got["b.CSV"][0]["rows"] == [["1"], ["2"]]
    page = sorted(got["d.html"], key=lambda r: r["block_index"])
    assert page[1]["text"] == "A & B — 中" and page[1]["level"] == 2 and page[4]["items"] == ["i", "j"] and (page[5]["headers"], page[5]["rows"]) == (["h", "k"], [["1", ""]])
    assert [r["text"] for r in sorted(got["e.txt"], key=lambda r: r["block_index"])] == ["one\nline", "two"]
    assert got["bad.csv"][0]["error"].startswith("UnicodeDecodeError") and got["f.xyz"][0]["error"] == "unroutable"


def test_a_parser_of_ones_own(spark, tmp_path):
    (tmp_path / "a.kv").write_text("x=1\ny=2")
    (tmp_path / "b.kv").write_text("no sign")
    own = {"pairs": lambda content: [{"kind": "pair", "items": line.split("=", 1)} for line in content.decode().split("\n") if line.index("=")]}
    routes = [("kv", "*", "pairs"), ("md", "*", "missing")]
    (tmp_path / "c.md").write_text("# x")
    rows = files.file_blocks(files.scanned(spark, str(tmp_path)), own, routes).collect()
    assert sorted(r["items"] for r in rows if r["kind"] == "pair") == [["x", "1"], ["y", "2"]]
    assert {r["path"][-4:]: r["error"] for r in rows if r["error"]} == {"b.kv": "ValueError: substring not found", "c.md": "missing"}


def _tasks(spark, group, act):
    """The most tasks of a stage of each job that ``act`` starts, and what it returns."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        out, tracker = act(), spark.sparkContext.statusTracker()
        found = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found, out


def test_many_small_files_are_written_and_listed_by_all_cores(spark, tmp_path):
    texts = spark.range(200).selectExpr("if(id = 7, null, id) as doc_id", "if(id = 9, null, concat('# t', id)) as value")
    files.write_files(texts, str(tmp_path / "made"))
    written = list((tmp_path / "made").glob("doc_id=*/*.txt"))
    assert len(written) == 200 and len({f.name[:10] for f in written}) == 4  # a part of the name for each task
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    tasks, found = _tasks(spark, "listing", lambda: files.scanned(spark, str(tmp_path)))
    assert max(tasks) <= files.LISTING_TASKS * spark.sparkContext.defaultParallelism and spark.conf.get(name) == before
    got = {r["path"].split("doc_id=")[1].split("/")[0]: bytes(r["content"]) for r in found.collect()}
    assert got == {"__HIVE_DEFAULT_PARTITION__" if i == 7 else str(i): b"\n" if i == 9 else f"# t{i}\n".encode() for i in range(200)}


def test_files_of_keys_that_are_names_are_those_of_sparks_writer(spark, tmp_path):
    numbers = spark.range(40).selectExpr("id % 10 as doc_id", "concat('v', id % 10) as value")
    for name, df in (("numbers", numbers), ("names", numbers.selectExpr("cast(doc_id as string) doc_id", "value"))):
        files.write_files(df, str(tmp_path / name))
    read = lambda name: {f.parent.name: f.read_bytes() for f in (tmp_path / name).glob("doc_id=*/*.txt")}
    assert read("numbers") == read("names") and read("names")["doc_id=3"] == b"v3\n" * 4
