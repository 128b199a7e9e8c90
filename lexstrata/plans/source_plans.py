"""Scans, manifests and sinks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexstrata.operators import chunking
from lexstrata.plans.base import Family
from lexstrata.sources import files, parsers, sinks, snapshots, tables
from lexstrata.sources.scratch import shared_folder

family = Family()
QUERIES, ORACLES = family.QUERIES, family.ORACLES


@family.query(
    "src01_active",
    """SELECT doc_id, source, n_chars FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(toxic, 0) = 0""",
)
def _(t):
    flags = t("labels").select("doc_id", F.col("toxic").alias("deleted"))
    return tables.active(t("documents").join(flags, "doc_id", "left")).select("doc_id", "source", "n_chars")


@family.query(
    "src02_csv_documents",
    """SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS row_index,
        concat('part "', l_partkey, '", no. ', l_linenumber) AS name, '' AS note FROM lineitem""",
)
def _(t):
    line = F.concat(F.lit('"part ""'), "l_partkey", F.lit('"", no. '), "l_linenumber", F.lit('"'))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", line.alias("line"))
    files = t("lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(order)).alias("x"))
    content = F.concat(F.lit("name,note\r\n\r\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\r\n"))
    rows = parsers.csv_rows(files.select("doc_id", content.alias("content")))
    return rows.select("doc_id", "row_index", F.col("cells")["name"].alias("name"), F.col("cells")["note"].alias("note"))


@family.query(
    "src02_files_to_blocks",
    """
    WITH c AS (SELECT 'csv' AS kind, l_suppkey AS doc_id, 'table' AS blocks, CAST(count(*) AS INTEGER) AS n_rows, 'order,part "no",' || l_suppkey AS head, CAST(NULL AS VARCHAR) AS error FROM lineitem GROUP BY l_suppkey),
    m AS (SELECT 'md', p_partkey, 'heading,list,table', 1, p_name, NULL FROM part),
    h AS (SELECT 'html', CAST(n_nationkey AS BIGINT), 'heading,paragraph,table', 1, n_name, NULL FROM nation),
    x AS (SELECT 'bin', CAST(r_regionkey AS BIGINT), '', 0, NULL, 'unroutable' FROM region)
    SELECT * FROM c UNION ALL SELECT * FROM m UNION ALL SELECT * FROM h UNION ALL SELECT * FROM x""",
)
def _(t):
    """A folder with a CSV file for each supplier, whose headers differ, Markdown for parts, pages for nations, and files of a kind that has no parser."""
    say = lambda *parts: F.concat(*(F.lit(x) if not isinstance(x, Column) else x.cast("string") for x in parts)).alias("value")
    line = F.struct("l_orderkey", "l_linenumber", say(F.col("l_orderkey"), ",", F.col("l_partkey"), ',"a, ""b"""').alias("x"))
    records = t("lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(line)).alias("r"))
    content = say('order,"part ""no""",', F.col("l_suppkey"), "\r\n\r\n", F.array_join(F.transform("r", lambda r: r["x"]), "\r\n"))
    made = {
        "csv": records.select(F.col("l_suppkey").alias("doc_id"), content),
        "md": t("part").select(F.col("p_partkey").alias("doc_id"), say("# ", F.col("p_name"), "\n\n- ", F.col("p_brand"), "\n- ", F.col("p_type"), "\n\n| size | price |\n| --- | --- |\n| ", F.col("p_size"), " | ", F.col("p_retailprice"), " |")),
        "html": t("nation").select(F.col("n_nationkey").alias("doc_id"), say("<h1>", F.col("n_name"), "</h1><p>region ", F.col("n_regionkey"), "</p><table><tr><th>key</th></tr><tr><td>", F.col("n_nationkey"), "</td></tr></table>")),
        "bin": t("region").select(F.col("r_regionkey").alias("doc_id"), say("?")),
    }
    folder = shared_folder(t.spark, "files")
    for kind, df in made.items():
        files.write_files(df, f"{folder}/kind={kind}")
    found = files.scanned(t.spark, folder).withColumn("kind", F.regexp_extract("path", "kind=([a-z]+)", 1))
    blocks = files.file_blocks(found).withColumn("at", F.struct("block_index", "kind"))
    first = F.coalesce("text", F.array_join("headers", ","))
    per = blocks.groupBy(F.regexp_extract("path", "kind=([a-z]+)", 1).alias("kind"), F.regexp_extract("path", "doc_id=(\\d+)", 1).cast("long").alias("doc_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda a: a["kind"]), ",").alias("blocks"),
        F.coalesce(F.sum(F.size("rows")), F.lit(0)).cast("int").alias("n_rows"),
        F.min_by(first, "block_index").alias("head"),
        F.max("error").alias("error"),
    )
    return per


@family.query("src03_markdown_blocks")
def _(t):
    return parsers.document_blocks(t("documents"))


@family.query(
    "src04_html_text",
    r"""
    WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', '', 'g') AS x FROM pages),
    b AS (SELECT page_id, regexp_replace(x, '(?s)<!--.*?-->', '', 'g') AS x FROM a),
    c AS (SELECT page_id, regexp_replace(x, '(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr|article|nav|footer|title)>', chr(10), 'g') AS x FROM b),
    d AS (SELECT page_id, regexp_replace(x, '(?s)<[^>]*>', '', 'g') AS x FROM c),
    e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS x FROM d)
    SELECT page_id, trim(regexp_replace(regexp_replace(x, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS body FROM e""",
)
def _(t):
    return t("pages").select("page_id", tables.html_text(F.col("html")).alias("body"))


@family.query(
    "src05_table_records",
    """SELECT l_orderkey AS sheet, CAST(l_linenumber AS INTEGER) AS row, l_orderkey AS order_no, any_value(CAST(l_partkey AS VARCHAR)) AS part
    FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) GROUP BY 1, 2""",
)
def _(t):
    # Two header rows, a merged order column, an empty column and one row for each line number.
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").cast("int").alias("row")).agg(F.max("l_partkey").cast("string").alias("part"))
    sheets = lines.select("sheet").distinct()
    cell = lambda df, row, col, value: df.select("sheet", F.lit(row).alias("row"), F.lit(col).alias("col"), value.cast("string").alias("value"))
    heads = cell(sheets, -1, 0, F.lit("order")).unionByName(cell(sheets, 0, 0, F.lit("order"))).unionByName(cell(sheets, -1, 1, F.lit("line"))).unionByName(cell(sheets, 0, 1, F.lit("part")))
    body = lines.select("sheet", "row", F.lit(1).alias("col"), F.col("part").alias("value")).unionByName(lines.select("sheet", "row", F.lit(2).alias("col"), F.lit(" ").alias("value")))
    first = lines.groupBy("sheet").agg(F.min("row").alias("row0"), F.max("row").alias("row1"))
    corner = first.select("sheet", F.col("row0").alias("row"), F.lit(0).alias("col"), F.col("sheet").cast("string").alias("value"))
    merges = first.select("sheet", "row0", F.lit(0).alias("col0"), "row1", F.lit(0).alias("col1"))
    present = lines.select("sheet", "row")
    filled = tables.expand_merges(heads.unionByName(body).unionByName(corner), merges)
    found = tables.table_rows(filled, header_rows=1).join(present, ["sheet", "row"], "left_semi")
    return found.select("sheet", "row", F.col("cells")["order"].cast("long").alias("order_no"), F.col("cells")["line|part"].alias("part"))


@family.query(
    "src06_routing",
    """SELECT page_id, CASE WHEN url LIKE 'https:%' THEN 'html-strict' WHEN page_id % 5 = 0 THEN 'unroutable' ELSE 'html-any' END AS parser FROM pages""",
)
def _(t):
    routes = t.spark.createDataFrame([("html", "secure", "html-strict"), ("html", "*", "html-any")], "kind string, profile string, parser string")
    secure = F.col("url").startswith("https:")
    kind = F.when((F.col("page_id") % 5 == 0) & ~secure, "other").otherwise("html")
    files = t("pages").select("page_id", kind.alias("kind"), F.when(secure, "secure").otherwise("plain").alias("profile"))
    return tables.routed(files, routes).select("page_id", "parser")


@family.query(
    "src07_idempotent_import",
    """SELECT doc_id, sha256(text) AS file_hash FROM documents
    WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)""",
)
def _(t):
    files = tables.with_content_hash(t("documents").select("doc_id", "text")).withColumn("parser_version", F.lit("1"))
    manifest = files.filter("doc_id % 2 = 0").select("file_hash", "parser_version")
    return tables.new_files(files, manifest, ["file_hash", "parser_version"]).select("doc_id", "file_hash")


@family.query(
    "src08_changed_sources",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'refresh' WHEN 2 THEN 'skip' ELSE CASE WHEN page_id % 8 = 7 THEN 'refresh' ELSE 'skip' END END AS action FROM pages""",
)
def _(t):
    turn = F.col("page_id") % 4
    seen = t("pages").select("page_id", F.when(turn < 2, F.concat(F.lit("e"), "page_id")).alias("etag"), F.when(turn == 2, F.length("html")).alias("modified"), F.sha2("html", 256).alias("digest"))
    html = F.when(F.col("page_id") % 8 == 7, F.concat("html", F.lit(" "))).otherwise(F.col("html"))
    now = t("pages").select("page_id", F.when(turn == 0, F.concat(F.lit("e"), "page_id")).when(turn == 1, F.lit("new")).alias("etag2"), F.length("html").alias("modified2"), F.sha2(html, 256).alias("digest2"))
    both = seen.join(now, "page_id")
    pair = lambda a: (F.col(a), F.col(a + "2"))
    return both.select("page_id", tables.source_action(pair("etag"), pair("modified"), pair("digest")).alias("action"))


@family.query(
    "src09_import_report",
    """
    WITH f AS (SELECT d.doc_id, sha256(text) AS h, coalesce(quality, 1) AS q, coalesce(toxic, 0) AS x, n_chars FROM documents d LEFT JOIN labels l USING (doc_id)),
    s AS (SELECT doc_id, n_chars, CASE WHEN h IN (SELECT h FROM f WHERE doc_id % 10 = 0) THEN 'SKIPPED' WHEN h IN (SELECT h FROM f WHERE x = 1) THEN 'HELD' WHEN q = 0 THEN 'REJECTED' ELSE 'IMPORTED' END AS status FROM f)
    SELECT status, count(*) AS files, CAST(sum(CASE WHEN status = 'IMPORTED' THEN 1 ELSE 0 END) AS BIGINT) AS attempts, CAST(sum(n_chars) AS BIGINT) AS chars FROM s GROUP BY status""",
)
def _(t):
    files = tables.with_content_hash(t("documents").join(t("labels"), "doc_id", "left"))
    files = files.withColumn("quality_status", F.when(F.coalesce("quality", F.lit(1)) == 0, "FAILED").otherwise("PASS"))
    report = tables.import_report(files, files.filter("doc_id % 10 = 0"), files.filter("toxic = 1"))
    return report.groupBy("status").agg(F.count("*").alias("files"), F.sum("attempts").alias("attempts"), F.sum("n_chars").alias("chars"))


RUN = """
    f AS (SELECT d.doc_id, sha256(text) AS h, text, coalesce(quality, 1) AS q, coalesce(toxic, 0) AS x FROM documents d LEFT JOIN labels l USING (doc_id)),
    s AS (SELECT doc_id, text, CASE WHEN h IN (SELECT h FROM f WHERE doc_id % 10 = 0) THEN 'SKIPPED' WHEN h IN (SELECT h FROM f WHERE x = 1) THEN 'HELD' WHEN q = 0 THEN 'REJECTED' ELSE 'IMPORTED' END AS status FROM f),
    a AS (SELECT l_orderkey AS doc_id, count(DISTINCT l_linenumber) - 1 AS retries, arg_max(l_returnflag, l_linenumber) AS flag FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) GROUP BY 1),
    rp AS (SELECT doc_id, text, CASE WHEN status = 'IMPORTED' AND retries IS NULL THEN 'PENDING' WHEN status = 'IMPORTED' AND flag = 'R' THEN 'FAILED' ELSE status END AS status,
           CASE WHEN status = 'IMPORTED' THEN coalesce(retries, 0) ELSE 0 END AS retries FROM s LEFT JOIN a USING (doc_id)),
    rs AS (SELECT *, CASE WHEN status = 'IMPORTED' THEN len(string_split(text, '. ')) ELSE 0 END AS clauses, CASE WHEN status = 'IMPORTED' THEN len(string_split(text, chr(10))) ELSE 0 END AS chunks FROM rp)"""


@family.query(
    "src09_run_totals",
    f"""WITH {RUN} SELECT count(*) AS tasks, count(*) FILTER (status IN ('IMPORTED', 'SKIPPED')) AS succeeded, count(*) FILTER (status NOT IN ('IMPORTED', 'SKIPPED')) AS failed,
        CAST(sum(retries) AS BIGINT) AS retries, CAST(sum(clauses) AS BIGINT) AS clauses, CAST(sum(chunks) AS BIGINT) AS chunks FROM rs""",
)
def _(t):
    """Order lines are the attempts on the document of the order's number, a returned line is one that failed."""
    files = tables.with_content_hash(t("documents").join(t("labels"), "doc_id", "left"))
    files = files.withColumn("quality_status", F.when(F.coalesce("quality", F.lit(1)) == 0, "FAILED").otherwise("PASS"))
    tasks = tables.import_report(files, files.filter("doc_id % 10 = 0"), files.filter("toxic = 1"))
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("attempt")).agg(F.max("l_returnflag").alias("flag"))
    attempts = lines.select("doc_id", "attempt", F.when(F.col("flag") == "R", "returned").alias("error"))
    clauses = t("documents").select("doc_id", F.explode(F.split("text", r"\. ")))
    return tables.run_totals(tables.run_report(tasks, attempts, clauses, _chunks(t)))


def _chunks(t):
    """The lines of every document as its chunks."""
    return t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))


def _store(t, tables: dict) -> snapshots.Snapshots:
    """An empty store for tables like the given frames, each with its key."""
    specs = {name: snapshots.TableSpec(df.schema, key, 8) for name, (df, key) in tables.items()}
    return snapshots.Snapshots(t.spark, shared_folder(t.spark, "store"), specs)


CHUNKS = """
    p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
    ch AS (SELECT doc_id, CAST(unnest(range(0, len(p))) AS INTEGER) AS chunk_index, unnest(p) AS content FROM p)"""


@family.query("snk01_replace_artefacts", f"WITH {CHUNKS} SELECT doc_id, chunk_index, content FROM ch WHERE doc_id % 3 <> 0 OR chunk_index = 0")
def _(t):
    """Written and read again: a first snapshot of all chunks, then one in which every third document has its first chunk only."""
    old = _chunks(t)
    store = _store(t, {"chunks": (old, "doc_id")})
    store.commit({"chunks": snapshots.replacement(old, "doc_id")})
    store.commit({"chunks": snapshots.replacement(old.filter("doc_id % 3 = 0 and chunk_index = 0"), "doc_id")})
    return store.read("chunks")


@family.query(
    "snk02_upsert_vectors",
    """SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM embeddings""",
)
def _(t):
    old = t("embeddings").withColumn("version", F.lit(1))
    new = old.filter("vec_id % 3 = 0").withColumns({"label": F.col("label") + 100, "version": F.lit(2)})
    fresh = new.unionByName(old.filter("vec_id % 7 = 0"))
    columns = ["vec_id", "label", "version"]
    store = _store(t, {"vectors": (old.select(columns), "vec_id")})
    store.commit({"vectors": snapshots.replacement(old.select(columns), "vec_id")})
    held = store.read("vectors").join(fresh.select("vec_id").distinct(), "vec_id", "left_semi").select(columns)
    store.commit({"vectors": snapshots.replacement(sinks.upserted(held, fresh.select(columns), "vec_id", "version"), "vec_id")})
    return store.read("vectors")


@family.query(
    "snk03_keyword_postings",
    r"""
    WITH w AS (SELECT doc_id, 'content' AS field, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents
               UNION ALL SELECT doc_id, 'source', unnest(regexp_extract_all(lower(source), '[\p{L}\p{N}]+')) FROM documents)
    SELECT term, field, doc_id, count(*) AS tf FROM w GROUP BY 1, 2, 3""",
)
def _(t):
    return sinks.postings(t("documents"), "doc_id", {"content": F.col("text"), "source": F.col("source")})


@family.query(
    "snk04_delete_in_step",
    """SELECT 'vector' AS side, label, count(*) AS n FROM embeddings WHERE vec_id % 5 <> 0 AND label <> 3 GROUP BY label
    UNION ALL SELECT 'keyword', label, count(*) FROM embeddings WHERE vec_id % 5 <> 0 AND label <> 3 GROUP BY label""",
)
def _(t):
    """Both indexes lose the rows in one commit."""
    chunks = t("embeddings").select("vec_id", "label")
    gone = chunks.filter("vec_id % 5 = 0 or label = 3").select("vec_id")
    store = _store(t, {side: (chunks, "vec_id") for side in ("vector", "keyword")})
    store.commit({side: snapshots.replacement(chunks, "vec_id") for side in ("vector", "keyword")})
    store.commit({side: snapshots.deletion(gone) for side in ("vector", "keyword")})
    sides = [store.read(side).withColumn("side", F.lit(side)) for side in ("vector", "keyword")]
    return sides[0].unionByName(sides[1]).groupBy("side", "label").agg(F.count("*").alias("n"))


@family.query(
    "snk05_eligible_chunks",
    r"""
    WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
    c AS (SELECT doc_id, CAST(unnest(range(0, len(p))) AS INTEGER) AS chunk_index, unnest(p) AS content FROM p)
    SELECT doc_id, chunk_index, content FROM c LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0 AND trim(content, ' ') <> ''""",
)
def _(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    flagged = lines.join(t("labels"), "doc_id", "left").select(
        "doc_id",
        "chunk_index",
        "content",
        (F.trim("content") != "").alias("index_eligible"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("enabled"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("deleted"),
    )
    return sinks.index_batches(flagged, int(t.spark.conf.get("spark.sql.shuffle.partitions"))).select("doc_id", "chunk_index", "content")


@family.query(
    "snk06_reindex",
    rf"""WITH {CHUNKS},
    w AS (SELECT doc_id, chunk_index, unnest(regexp_extract_all(lower(concat(content, chr(10), 'chunk ', chunk_index)), '[\p{{L}}\p{{N}}]+')) AS term FROM ch),
    n AS (SELECT term, doc_id, chunk_index, count(*) AS tf FROM w GROUP BY 1, 2, 3)
    SELECT term, count(*) AS chunks, CAST(sum(tf) AS BIGINT) AS tf FROM n GROUP BY term""",
)
def _(t):
    chunks = _chunks(t)
    body = sinks.retrieval_text(F.col("content"), F.concat(F.lit("chunk "), F.col("chunk_index").cast("string")))
    terms = sinks.postings(chunks.select(F.concat_ws(":", "doc_id", "chunk_index").alias("id"), body.alias("body")), "id", {"retrieval": F.col("body")})
    return terms.groupBy("term").agg(F.count("*").alias("chunks"), F.sum("tf").alias("tf"))


