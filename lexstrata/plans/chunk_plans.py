"""Chunking of documents, tables and clauses."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexstrata.functions import text
from lexstrata.operators import chunking
from lexstrata.plans.base import Family
from lexstrata.plans.structure_plans import chinese_lines
from lexstrata.operators import structure
from lexstrata.sources import parsers

family = Family()
QUERIES, ORACLES = family.QUERIES, family.ORACLES


def _markdown(t):
    """Documents of every block kind, made of the corpus's own paragraphs."""
    lines = F.split("text", "\n")
    at = lambda i: F.coalesce(F.try_element_at(lines, F.lit(i)), F.lit("end"))
    items = F.array_join(F.transform(F.split(at(1), " "), lambda w: F.concat(F.lit("- "), w)), "\n")
    rows = F.array_join(F.transform(F.split(at(2), " "), lambda w: F.concat(F.lit("| "), w, F.lit(" | "), F.length(w), F.lit(" |"))), "\n")
    body = F.concat_ws(
        "\n\n", F.concat(F.lit("# "), "source"), at(1), F.lit("## List"), items, F.lit("## Table"), F.concat(F.lit("| word | size |\n| --- | --- |\n"), rows),
        F.concat(F.lit("```text\n"), at(3), F.lit("\n```")), F.concat(F.lit("![figure](http://host/"), "doc_id", F.lit(".png)")), "text",
    )
    return t("documents").select("doc_id", body.alias("text"))


@family.query("chk01_chunk_documents")
def _(t):
    return chunking.chunk_documents(_markdown(t))


@family.query("chk02_paragraph_split")
def _(t):
    return chunking.paragraph_chunks(t("documents"))


def _pieces(t, kind):
    """Chunks of one block kind, without packing."""
    blocks = parsers.document_blocks(_markdown(t)).filter(F.col("kind") == kind)
    budget = chunking.Budget()

    def cut(batches):
        import pandas as pd

        for batch in batches:
            out = [
                (b["doc_id"], b["block_index"], i, content, embed)
                for b in batch.to_dict("records")
                for i, (content, embed) in enumerate(chunking.block_pieces(b, budget))
            ]
            yield pd.DataFrame(out, columns=["doc_id", "block_index", "piece", "content", "embedding_text"])

    return blocks.mapInPandas(cut, "doc_id long, block_index int, piece int, content string, embedding_text string")


@family.query("chk03_list_groups")
def _(t):
    return _pieces(t, "list")


@family.query(
    "chk04_table_row_groups",
    """
    WITH n AS (SELECT o_custkey AS table_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, concat('order: ', o_orderkey, '; status: ', o_orderstatus) AS x FROM orders)
    SELECT table_id, CAST(i // 5 AS INTEGER) AS chunk_index, count(*) AS n_rows, string_agg(x, chr(10) ORDER BY i) AS content FROM n GROUP BY 1, 2""",
)
def _(t):
    cells = text.row_text([("order", F.col("o_orderkey")), ("status", F.col("o_orderstatus"))])
    return chunking.table_chunks(t("orders"), "o_custkey", ["o_orderkey"], cells, rows_per_chunk=5)


@family.query("chk05_html_table_groups")
def _(t):
    row = F.concat(F.lit('<tr><td colspan="1" rowspan=\'1\'>'), "p_partkey", F.lit("</td><td>"), "p_name", F.lit("</td></tr>"))
    tables = t("part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"))
    html = tables.select("p_brand", F.concat(F.lit("<table><tr><th>key</th><th>name</th></tr>"), "rows", F.lit("</table>")).alias("html"))
    budget = chunking.Budget()

    def cut(batches):
        import pandas as pd

        for batch in batches:
            out = [(b, i, x) for b, h in zip(batch["p_brand"], batch["html"], strict=True) for i, x in enumerate(chunking.html_table_groups(h, budget))]
            yield pd.DataFrame(out, columns=["p_brand", "piece", "content"])

    return html.mapInPandas(cut, "p_brand string, piece int, content string")


@family.query("chk06_code_groups")
def _(t):
    return _pieces(t, "code")


@family.query("chk07_image_chunks", "SELECT page_id, concat('Page ', page_id, chr(10), '![shot](', url, ')') AS content, concat('Page ', page_id) AS embedding_text FROM pages")
def _(t):
    about = F.concat(F.lit("Page "), F.col("page_id"))
    return t("pages").select("page_id", chunking.image_chunk(about, F.lit("shot"), F.col("url")).alias("content"), about.alias("embedding_text"))


@family.query("chk08_heading_chunks", "SELECT p_partkey, concat(repeat('#', p_size % 6 + 1), ' ', p_name) AS content, p_name AS embedding_text FROM part")
def _(t):
    return t("part").select("p_partkey", chunking.heading_chunk(F.col("p_size") % 6 + 1, F.col("p_name")).alias("content"), F.col("p_name").alias("embedding_text"))


@family.query("chk09_packed_outlines")
def _(t):
    return chunking.chunk_documents(_markdown(t)).groupBy("outline").agg(F.count("*").alias("chunks"), F.max(F.length("content")).alias("longest"))


@family.query(
    "chk10_embedding_text",
    """SELECT doc_id, CASE WHEN contains(text, source) THEN text ELSE concat(source, chr(10), CASE WHEN contains(text, lang) THEN '' ELSE lang || chr(10) END, text) END AS embedding_text FROM documents""",
)
def _(t):
    return t("documents").select("doc_id", chunking.embedding_text(F.array("source", "lang"), F.col("text")).alias("embedding_text"))


@family.query("chk11_clause_chunks")
def _(t):
    """Clauses of Chinese lines, some of them far over the limit of 450 tokens."""
    long = F.repeat(F.col("line"), (F.col("line_index") % 13 * F.col("line_index") % 11 + 1).cast("int"))
    lines = chinese_lines(t).withColumn("line", F.when(F.col("line").endswith("。"), F.concat("line", F.repeat("line", (F.col("line_index") % 47).cast("int")))).otherwise(long))
    clauses = structure.clauses(structure.classified(lines))
    return chunking.clause_chunks(clauses.withColumns({"title": F.concat(F.lit("规范"), "doc_id"), "standard_no": F.when(F.col("doc_id") % 2 == 0, "GB 1-2020")}))


@family.query(
    "chk12_range_labels",
    """
    WITH d AS (SELECT l_orderkey, l_linenumber AS n FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, CASE WHEN count(*) = 1 THEN concat('(', min(n), ')') ELSE concat('(', min(n), ')~(', max(n), ')') END AS label FROM d GROUP BY 1""",
)
def _(t):
    marks = F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda n: F.concat(F.lit("("), n.cast("string"), F.lit(")")))
    return t("lineitem").groupBy("l_orderkey").agg(marks.alias("marks")).select("l_orderkey", chunking.range_label(F.col("marks")).alias("label"))


@family.query("chk13_embedding_column")
def _(t):
    return chunking.embedded(chunking.paragraph_chunks(t("documents")), ["doc_id", "chunk_index"], "content")


@family.query(
    "chk14_top_terms",
    r"""
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT doc_id, term, round(tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 6) AS weight FROM tf JOIN df USING (term)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS INTEGER) AS rank FROM s)
    SELECT doc_id, rank, term, weight FROM r WHERE rank <= 5""",
)
def _(t):
    return chunking.top_terms(t("documents"))


@family.query("chk15_pipeline_metadata", "SELECT doc_id, 'ingest' AS pipeline, source, CAST(NULL AS VARCHAR) AS lang FROM documents")
def _(t):
    own = F.create_map(F.lit("pipeline"), F.lit("old"), F.lit("lang"), F.col("lang"))
    meta = chunking.with_metadata(own, {"pipeline": F.lit("ingest"), "source": F.col("source")}, ["pipeline", "source"])
    return t("documents").select("doc_id", meta.alias("m")).select("doc_id", *(F.col("m")[k].alias(k) for k in ("pipeline", "source", "lang")))


@family.query(
    "chk14_enrichment_hook",
    """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), c AS (SELECT doc_id, CAST(unnest(range(0, len(p))) AS INTEGER) AS chunk_index, unnest(p) AS content FROM p)
    SELECT doc_id, chunk_index, substr(content, 1, 40) AS summary, CAST(len(content) AS VARCHAR) AS length, CAST(NULL AS VARCHAR) AS enrich_error FROM c""",
)
def _(t):
    """Plain functions stand where models would."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    tasks = {"summary": lambda texts: [x[:40] for x in texts], "length": lambda texts: [len(x) for x in texts]}
    return chunking.enriched(lines, "content", tasks).drop("content")
