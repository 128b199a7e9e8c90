"""Numeric entities, the import report, and the hook for models."""

from pyspark.sql import functions as F

from lexstrata.operators import chunking
from lexstrata.sources import tables


def test_numeric_entities(spark):
    rows = [("<b>a&#8212;b &#x4e2d;&#X1F600; &amp;#65; &#39;q&#39;</b>", "a—b 中😀 &#65; 'q'"), ("&#0;&#xD800;&#9999999;&#;", "&#0;&#xD800;&#9999999;&#;"), ("&lt;&#60;", "<<"), (None, None)]
    df = spark.createDataFrame(rows, "html string, want string")
    assert [r["got"] for r in df.select(tables.html_text(F.col("html")).alias("got")).collect()] == [w for _, w in rows]


def test_run_report(spark):
    tasks = spark.createDataFrame([(1, "IMPORTED"), (2, "IMPORTED"), (3, "IMPORTED"), (4, "SKIPPED"), (5, "HELD")], "doc_id long, status string")
    attempts = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (2, 1, None), (2, 2, "late"), (2, 3, "late"), (4, 1, "old")], "doc_id long, attempt int, error string")
    parts = spark.createDataFrame([(1,), (1,), (2,), (4,)], "doc_id long")
    report = tables.run_report(tasks, attempts, parts, parts.filter("doc_id = 1"))
    got = {r["doc_id"]: tuple(r)[1:] for r in report.collect()}
    assert got == {1: ("IMPORTED", 1, 2, 2, None), 2: ("FAILED", 2, 0, 0, "late"), 3: ("PENDING", 0, 0, 0, None), 4: ("SKIPPED", 0, 0, 0, None), 5: ("HELD", 0, 0, 0, None)}
    assert tuple(tables.run_totals(report).first()) == (5, 2, 3, 3, 2, 2)
    assert tuple(tables.run_totals(report.filter("doc_id > 9")).first()) == (0, 0, 0, 0, 0, 0)


def test_model_hook(spark):
    def fussy(texts):
        if any("bad" in x for x in texts):
            raise RuntimeError("no")
        return [x.upper() for x in texts]

    chunks = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "d")], "id long, content string").coalesce(1)
    got = {r["id"]: (r["big"], r["n"], r["enrich_error"]) for r in chunking.enriched(chunks, "content", {"big": fussy, "n": lambda texts: [len(x) for x in texts]}).collect()}
    assert got == {1: ("A", "1", None), 2: (None, "3", "big: RuntimeError: no"), 3: ("", "0", None), 4: ("D", "1", None)}
    short = chunking.enriched(chunks, "content", {"big": lambda texts: texts[:1]}, retries=0)
    assert {r["big"] for r in short.collect()} == {"a", "bad", "", "d"}
