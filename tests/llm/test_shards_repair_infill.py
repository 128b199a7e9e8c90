"""Sharding, conversation repair and fill-in-middle against brute force on small tables."""

import hashlib
import heapq
import itertools
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexstrata.llm import infill, repair, sharding

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, shard int, bucket int, record string, form string, at int, _copies int"
TURNS = "conv_id long, turn long, role string, text string, part int, cost string, rows int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "s", 1, 2, "r", "f", 3, 4) for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    prose = lambda n: "".join(r.choice("abc <>PSM\n😀é") for _ in range(n))
    out = [(1, None), (2, ""), (3, " "), (4, "x<P>y"), (5, "a<S"), (6, "ends <"), (7, prose(9000)), (None, None), (None, "no id")]
    out += [(10 + i, prose(r.randint(0, 60)).replace("<P>", "").replace("<S>", "").replace("<M>", "")) for i in range(300)]
    out += [(4000, "the same row")] * 700 + [(5000 + i, "the same text") for i in range(400)]
    return out


def size_of(text):
    return len((text or "").encode()) + 8


def drawn(below, *key):
    return int(hashlib.sha256(":".join(map(str, key)).encode()).hexdigest()[:8], 16) % below


def brute_shards(texts, shards):
    rows, seen = [], Counter()
    for i, t in texts:
        row = (i, size_of(t), zlib.crc32((t or "").encode()))
        rows.append((*row, seen[row]))
        seen[row] += 1
    buckets = max(1, -(-len(rows) // sharding.BUCKET_ROWS), -(-sum(r[1] for r in rows) // sharding.BUCKET_BYTES))
    low = lambda r: tuple((x is not None, x) for x in r)
    order = []
    for b in range(buckets):
        inside = sorted((r for r in rows if drawn(buckets, 1, *("" if x is None else x for x in r)) == b), key=low)
        at = []
        for i in range(len(inside)):
            j = drawn(i + 1, 1, b, i)
            at.append(i)
            at[i], at[j] = at[j], at[i]
        order += [inside[k][:3] for k in at]
    out, each, longer = [], len(rows) // shards, len(rows) % shards
    for s in range(shards):
        n = each + (s < longer)
        out += [(*r, s, k) for k, r in enumerate(order[:n])]
        order = order[n:]
    return sorted(out, key=low)


@pytest.mark.parametrize("bucket_rows,fan,shards", [(512, 1024, 24), (7, 4, 5), (100, 2, 2000)])
def test_shards(spark, texts, bucket_rows, fan, shards, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(sharding, "FAN", fan)
    digests = sharding.text_digests(docs(spark, texts))
    assert digests.columns == ["doc_id", "size", "text_crc32"]
    found = sharding.shuffled_shards(digests, shards).collect()
    low = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in found), key=low) == brute_shards(texts, shards)


def test_shards_do_not_follow_the_partitions(spark, texts):
    once = sharding.shuffled_shards(sharding.text_digests(docs(spark, texts).repartition(3)), 7)
    again = sharding.shuffled_shards(sharding.text_digests(docs(spark, texts).repartition(5, "doc_id")), 7)
    assert once.exceptAll(again).isEmpty()
    other = sharding.shuffled_shards(sharding.text_digests(docs(spark, texts)), 7, seed=2)
    assert not once.exceptAll(other).isEmpty()


def test_shards_of_an_empty_table_and_of_equal_rows(spark):
    none = docs(spark, [(1, "a")]).filter("doc_id > 1")
    assert sharding.shuffled_shards(sharding.text_digests(none), 24).count() == 0
    one = spark.range(30_000).select(F.lit(1).alias("doc_id"), F.lit("a").alias("text"))
    rows = sharding.shuffled_shards(sharding.text_digests(one), 24).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert [(r["n"], r["d"], r["m"]) for r in rows] == [(1250, 1250, 1249)] * 24


def test_written_shards(spark, texts, tmp_path):
    rows = docs(spark, texts).drop("shard")
    sharding.write_shards(rows, str(tmp_path / "shards"), 6)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.drop("shard", "slot").exceptAll(rows.select(back.drop("shard", "slot").columns)).isEmpty() and back.count() == len(texts)
    counts = [r["count"] for r in back.groupBy("shard").count().collect()]
    assert len(counts) == 6 and max(counts) - min(counts) <= 1


def test_whole_records_move_with_their_keys(spark, texts, tmp_path):
    """Rows that repeat id and text, and differ elsewhere, are numbered together; the shards hold whole rows in the order of the digests."""
    more = [(7000, "same key")] * 40
    rows = docs(spark, texts).drop("shard").unionByName(docs(spark, more).drop("shard").withColumn("source", (F.monotonically_increasing_id() % 5).cast("string")))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    sharding.write_shards(rows.repartition(5), str(tmp_path / "shards"), 6)
    back = sharding.read_shards(rows, str(tmp_path / "shards"))
    assert back.select(rows.columns).exceptAll(rows).isEmpty() and back.count() == rows.count()
    low = lambda r: tuple((x is not None, x) for x in r)
    found = sharding.text_digests(back, others=("shard", "slot")).collect()
    assert sorted((tuple(r) for r in found), key=low) == brute_shards(texts + more, 6)


def test_query_reads_its_digests_from_whole_records(spark, tmp_path, monkeypatch):
    from lexstrata.llm import queries

    seen = []
    write = queries.write_shards
    monkeypatch.setattr(queries, "write_shards", lambda docs, path, shards: (seen.append(path), write(docs, path, shards)))
    docs(spark, [(i, f"text {i}") for i in range(100)]).drop("shard").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op11_shuffled_shards(spark, str(tmp_path)).count() == 100
    rows = spark.read.parquet(seen[0]).collect()
    assert sorted(r["text"] for r in rows) == sorted(f"text {i}" for i in range(100)) and len({r["shard"] for r in rows}) == 24
    docs(spark, []).drop("shard").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op11_shuffled_shards(spark, str(tmp_path / "none")).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute_edits(rows):
    """Least cost and audit by one plain search over whole audits; rows as (initial, must go, truncated)."""
    step = {("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a", ("", "s"): "s"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        following = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 5, audit + "I", i, following))
        if i < len(rows):
            initial, must, cut = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state))
            if not must:
                heapq.heappush(heap, (cost + 1 + 5 * cut, audit + "R", i + 1, following))
                if (state, initial) in step:
                    heapq.heappush(heap, (cost + 5 * cut, audit + "K", i + 1, step[state, initial]))


def brute_repair(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in brute_damage([r for r in rows if r[0] == conv])), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, shapes, count = set(), [], Counter()
        for _, _, role, text in turns:
            marks = WORD.findall(text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
            count[fault] += 1
            seen.add((role, text))
            shapes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit = brute_edits(shapes)
        said, at, state = [], 0, ""
        for x in audit:
            if x == "K":
                state = turns[at][2][:1]
                said.append(f"{turns[at][2]}:{turns[at][3]}")
            elif x in "RI":
                state = "a" if state == "u" else "u"
                said.append(f"{'user' if state == 'u' else 'assistant'}:{turns[at][3] if x == 'R' else ''}")
            at += x != "I"
        nums = [r[1] for r in turns if r[1] is not None]
        gaps = max(nums) - min(nums) + 1 - len(set(nums)) if nums else 0
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.fixture(scope="module")
def turns():
    r = random.Random(12)
    say = lambda: r.choice(["Yes.", "No!", "cut off", "", " \n", "why?", "again.", f"{r.random()}.", "end. ", "über…", "😀!", "　."])
    role = lambda: r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "unknown", None])
    rows = [(c, t, ("user", "assistant")[t % 2] if r.random() < 0.7 else role(), say()) for c in range(120) for t in range(r.randint(1, 14))]
    rows += [(None, t, role(), None) for t in range(5)] + [(200, None, role(), say()) for _ in range(9)] + [(201, 5, None, None)]
    rows += [(202, t // 3 * 2, role(), say()) for t in range(700)] + [(203, 7, "user", "same.")] * 600 + [(203, 8 + t, role(), say()) for t in range(50)]
    rows += [(300 + k, 1, "user", "Hi.") for k in range(60)] + [(204, 1, "assistant", "x" * 50_000 + "."), (204, 2, "user", "y" * 9_000)]
    r.shuffle(rows)
    return rows


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2) for r in rows], TURNS)


@pytest.mark.parametrize("most", [256, 3])
def test_repair(spark, turns, most, monkeypatch):
    """The second round cuts nearly every conversation into segments."""
    monkeypatch.setattr(repair, "SEGMENT_ROWS", most)
    found = repair.damage_and_repair(conversations(spark, turns).repartition(3)).collect()
    got = sorted((tuple(r) for r in found), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == brute_repair(turns)


def test_repair_of_few_rows(spark):
    none = conversations(spark, [(1, 1, "user", "x")]).filter("conv_id > 1")
    assert repair.damage_and_repair(none).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    only = repair.damage_and_repair(conversations(spark, [(gone, 1, "user", "x")])).first()
    assert tuple(only) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows(spark, turns):
    found, said = repair.repaired(repair.damaged(conversations(spark, turns)))
    rows = repair.exploded(said).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["part"], r["seq"], r["at"])):
        by.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in found.collect():
        assert hashlib.sha256("\n".join(by.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in by.get(r["conv_id"], [])))


def test_cheapest_way_in_random_lattices():
    r = random.Random(13)
    for _ in range(3000):
        rows = [(r.choice("suaut"), r.random() < 0.15, r.random() < 0.2) for _ in range(r.randint(0, 12))]
        assert repair.cheapest([(i, int(m), c) for i, m, c in rows]) == brute_edits(rows), rows


def brute_infill(texts):
    out = []
    for i, t in texts:
        t, n = t or "", len(t or "")
        digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 90:
            out.append((i, n, "plain", None, None, sha(t), sha(t), t))
            continue
        form = "spm" if h[3] % 100 < 20 else "psm"
        p, m, s = "<P>" + t[:a], "<M>" + t[a:b], "<S>" + t[b:]
        whole = s + p + m if form == "spm" else p + s + m
        out.append((i, n, form, a, b - a, sha(whole), sha(t), whole))
    return out


@pytest.mark.parametrize("unit", [1 << 16, 2])
def test_infill(spark, texts, unit, monkeypatch):
    monkeypatch.setattr(infill.output_pieces, "__defaults__", (unit,))
    low = lambda r: tuple((x is not None, x) for x in r)
    found = infill.fill_in_middle(docs(spark, texts)).collect()
    want = brute_infill(texts)
    assert sorted((tuple(r) for r in found), key=low) == sorted((x[:-1] for x in want), key=low)
    assert {r["form"] for r in found} == {"plain", "spm", "psm"}
    written = infill.transformed(docs(spark, texts))
    assert written.columns == docs(spark, texts).columns
    assert sorted(((r["doc_id"], r["text"]) for r in written.collect()), key=low) == sorted(((x[0], x[-1]) for x in want), key=low)


def test_infill_of_an_empty_table(spark):
    assert infill.fill_in_middle(docs(spark, [(1, "a")]).filter("doc_id > 1")).count() == 0


def test_marks_that_lie_across_pieces():
    for form in ("psm", "spm"):
        for size in (1, 2, 3, 5):
            text = "ab<P<S"
            whole = "<P>" + text + "<S>" + "<<S" + "<M>" + "x<" if form == "psm" else "<S>" + "<<S" + "<P>" + text + "<M>" + "x<"
            r, parts = infill.Restorer(form), Counter()
            out = {"P": "", "S": "", "M": ""}
            for k in range(0, len(whole), size):
                for part, s in r.feed(whole[k : k + size]):
                    out[part] += s
            for part, s in r.feed("", True):
                out[part] += s
            assert out == {"P": text, "S": "<<S", "M": "x<"} and not parts


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["op11_shuffled_shards", "op12_conversation_repair", "op13_fill_in_middle"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from lexstrata.llm import queries

    base = duckdb.connect()
    for table in ("documents", "conversations"):
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = queries.QUERIES[name](spark, FOLDER)
    want = base.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, found.select(want.columns).collect()))) == sorted(map(repr, want.fetchall()))
