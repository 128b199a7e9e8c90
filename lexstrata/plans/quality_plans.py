"""Corpus quality over documents, regulation lines and derived review signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexstrata.operators import quality, structure
from lexstrata.plans.base import Family
from lexstrata.plans.structure_plans import CLAUSES, LINES, regulation_lines

family = Family()
QUERIES, ORACLES = family.QUERIES, family.ORACLES


def _lines(t):
    return structure.classified(regulation_lines(t))


def _clauses(t):
    return structure.clauses(_lines(t))


def _short(t):
    """Clauses by the first part of their number, so that numbers repeat."""
    body = F.when(F.col("clause_id") % 5 == 0, F.col("text")).otherwise(F.col("clause_no"))
    return _clauses(t).withColumns({"clause_no": F.substring_index("clause_no", ".", 1), "text": body})


@family.query(
    "qlt01_quality_report",
    CLAUSES + """,
    e AS (SELECT doc_id, count(*) AS n_elements, CAST(sum(length(line)) AS BIGINT) AS n_chars, count(*) FILTER (line_type = 'text') AS n_unstructured FROM typed GROUP BY 1),
    q AS (SELECT doc_id, count(*) AS n_clauses, count(*) - count(DISTINCT (role, clause_no, text)) AS n_duplicates, count(*) FILTER (role = 'FRONT_MATTER') AS n_unknown_role,
            count(*) AS n_chunks, count(*) FILTER (trim(text, ' ') = '') AS n_empty, count(*) FILTER (length(text) > 120) AS n_oversized FROM c GROUP BY 1)
    SELECT doc_id, n_elements, n_chars, n_unstructured, coalesce(n_clauses, 0) AS n_clauses, coalesce(n_duplicates, 0) AS n_duplicates, coalesce(n_unknown_role, 0) AS n_unknown_role,
        coalesce(n_chunks, 0) AS n_chunks, coalesce(n_empty, 0) AS n_empty, coalesce(n_oversized, 0) AS n_oversized,
        CASE WHEN coalesce(n_clauses, 0) = 0 OR n_empty > 0 THEN 'FAILED' WHEN n_oversized > 0 OR n_duplicates > 0 OR n_unstructured > 0.6 * n_elements OR n_unknown_role > 0.05 * n_clauses THEN 'REVIEW' ELSE 'PASS' END AS status
    FROM e LEFT JOIN q USING (doc_id)""",
)
def _(t):
    clauses = _clauses(t)
    chunks = clauses.select("doc_id", F.col("text").alias("content"), F.length("text").alias("tokens"))
    return quality.quality_report(_lines(t), clauses, chunks, unstructured_share=0.6, most_tokens=120)


@family.query(
    "qlt02_duplicate_clauses",
    CLAUSES + """ SELECT doc_id, clause_id, min(clause_id) OVER (PARTITION BY doc_id, role, string_split(clause_no, '.')[1]) AS canonical_id,
        clause_id = min(clause_id) OVER (PARTITION BY doc_id, role, string_split(clause_no, '.')[1]) AS index_eligible FROM c""",
)
def _(t):
    return quality.marked_duplicates(_short(t), ["doc_id", "role", "clause_no"], "clause_id").select("doc_id", "clause_id", "canonical_id", "index_eligible")


@family.query(
    "qlt03_duplicate_groups",
    CLAUSES + """,
    h AS (SELECT doc_id, string_split(clause_no, '.')[1] AS clause_no, role, CASE WHEN clause_id % 5 = 0 THEN text ELSE clause_no END AS text FROM c),
    r AS (SELECT doc_id, clause_no, role, count(*) AS n, count(DISTINCT text) AS k FROM h GROUP BY 1, 2, 3),
    s AS (SELECT doc_id, clause_no, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2 HAVING count(*) FILTER (role IN ('NORMATIVE', 'COMMENTARY')) = 2)
    SELECT doc_id, clause_no, role, CASE WHEN k = 1 THEN 'EXACT' ELSE 'NEAR' END AS kind, n FROM r WHERE n > 1
    UNION ALL SELECT doc_id, clause_no, '*', 'STRUCTURAL', n FROM s""",
)
def _(t):
    return quality.duplicate_groups(_short(t))


@family.query("qlt04_exact_copies", "SELECT sha256(text) AS file_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return quality.exact_copies(t("documents"))


@family.query(
    "qlt05_unstructured_lines",
    r"""
    WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS x FROM documents),
    k AS (SELECT CASE WHEN regexp_matches(x, '^(?:Figure|Table|图|表)\s*\d+') THEN 'caption' WHEN regexp_matches(x, '(?:\s{3,}\S+){2,}|\|') THEN 'table_residue'
        WHEN regexp_matches(x, '^[^\p{L}]*[=+/*^<>-][^\p{L}]*$') THEN 'formula' WHEN regexp_matches(x, '(?i)^(?:author|date|version|copyright|all rights reserved)\b') THEN 'metadata'
        WHEN regexp_matches(x, '(?i)^(?:appendix|附录)') THEN 'appendix' WHEN length(x) <= 40 AND NOT regexp_matches(x, '[.!?。！？;；,，]$') THEN 'heading_like' ELSE 'normal' END AS kind FROM l)
    SELECT kind, count(*) AS n FROM k GROUP BY kind""",
)
def _(t):
    lines = t("documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(quality.unstructured_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


@family.query(
    "qlt06_source_coverage",
    f"""WITH {LINES},
    n AS (SELECT doc_id, line_index, length(regexp_replace(line, '\\s+', '', 'g')) AS n, line_type <> 'text' AS owned FROM typed),
    g AS (SELECT *, NOT owned AND coalesce(lag(owned) OVER (PARTITION BY doc_id ORDER BY line_index), true) AS start FROM n WHERE n > 0)
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS chars, CAST(sum(CASE WHEN owned THEN n ELSE 0 END) AS BIGINT) AS covered, count(*) FILTER (start) AS gaps,
        round(sum(CASE WHEN owned THEN n ELSE 0 END) / sum(n), 6) AS share FROM g GROUP BY doc_id""",
)
def _(t):
    return quality.coverage(_lines(t), F.col("line_type") != "text")


@family.query(
    "qlt06_coverage_by_spans",
    f"""WITH {LINES},
    n AS (SELECT doc_id, line_index, length(regexp_replace(line, '\\s+', '', 'g')) AS n FROM typed),
    s AS (SELECT doc_id, line_index AS lo, line_index + CASE line_type WHEN 'clause' THEN 1 WHEN 'chapter' THEN 6 ELSE 0 END AS hi FROM typed WHERE line_type IN ('clause', 'chapter', 'role')),
    w AS (SELECT n.doc_id, line_index, any_value(n) AS n, bool_or(lo IS NOT NULL) AS owned FROM n LEFT JOIN s ON s.doc_id = n.doc_id AND line_index BETWEEN lo AND hi GROUP BY 1, 2),
    g AS (SELECT *, NOT owned AND coalesce(lag(owned) OVER (PARTITION BY doc_id ORDER BY line_index), true) AS start FROM w WHERE n > 0)
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS chars, CAST(sum(CASE WHEN owned THEN n ELSE 0 END) AS BIGINT) AS covered, count(*) FILTER (start) AS gaps,
        round(sum(CASE WHEN owned THEN n ELSE 0 END) / sum(n), 6) AS share FROM g GROUP BY doc_id""",
)
def _(t):
    """A clause owns the line behind it too, a chapter the six behind its title."""
    lines = _lines(t)
    behind = F.when(F.col("line_type") == "clause", 1).when(F.col("line_type") == "chapter", 6).otherwise(0)
    owners = lines.filter(F.col("line_type").isin("clause", "chapter", "role"))
    return quality.coverage_by_spans(lines, owners.select("doc_id", F.col("line_index").alias("start"), (F.col("line_index") + behind).alias("end")))


@family.query(
    "qlt07_signatures",
    CLAUSES + " SELECT doc_id, sha256(string_agg(sha256(text), ',' ORDER BY clause_id)) AS signature FROM c GROUP BY doc_id",
)
def _(t):
    return quality.signature(_clauses(t), "doc_id", "clause_id", "text")


@family.query(
    "qlt08_sequence_gaps",
    """
    WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), g AS (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS b FROM d)
    SELECT l_orderkey, l_linenumber, b + 1 AS expected FROM g WHERE l_linenumber > b + 1""",
)
def _(t):
    return quality.sequence_gaps(t("lineitem"), ["l_orderkey"], "l_linenumber")


@family.query(
    "qlt08_clause_gaps",
    CLAUSES + """,
    p AS (SELECT *, string_split(clause_no, '.')[1] AS prefix, CAST(string_split(clause_no, '.')[2] AS BIGINT) AS last FROM c),
    g AS (SELECT *, lag(prefix) OVER w AS p, lag(last) OVER w AS l FROM p WINDOW w AS (PARTITION BY doc_id, chapter_no, section_no ORDER BY clause_id))
    SELECT doc_id, clause_id, clause_no, prefix || '.' || (l + 1) AS expected FROM g WHERE prefix = p AND last > l + 1""",
)
def _(t):
    return quality.clause_gaps(_clauses(t))


@family.query(
    "qlt09_enumeration_gaps",
    f"""WITH {LINES},
    i AS (SELECT doc_id, line_index, CAST(number[2] AS INTEGER) AS marker, coalesce(lag(CAST(number[2] AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_index), 0) AS b FROM typed WHERE line_type = 'item'),
    g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_index) AS r FROM i WHERE marker <> 1 AND marker <> b + 1)
    SELECT doc_id, line_index, marker, b + 1 AS expected FROM g WHERE r = 1""",
)
def _(t):
    items = _lines(t).filter("line_type = 'item'").select("doc_id", "line_index", F.regexp_extract("number", r"\d+", 0).cast("int").alias("marker"))
    return quality.first_enumeration_gaps(items, ["doc_id"], "line_index", "marker")


@family.query(
    "qlt10_metadata_warnings",
    """SELECT doc_id, list_filter([CASE WHEN doc_id % 4 = 0 THEN 'missing title' END, CASE WHEN doc_id % 6 = 0 THEN 'missing standard' END, CASE WHEN doc_id % 9 = 0 THEN 'missing year' END], lambda x: x IS NOT NULL) AS warnings FROM documents""",
)
def _(t):
    fields = {
        "title": F.when(F.col("doc_id") % 4 != 0, F.col("source")),
        "standard": F.when(F.col("doc_id") % 6 == 0, F.lit(" ")).otherwise(F.col("lang")),
        "year": F.when(F.col("doc_id") % 9 != 0, F.col("n_chars")),
    }
    return t("documents").select("doc_id", quality.metadata_warnings(fields).alias("warnings"))


def _signals(t):
    """One signal for each order with a gap: its chunks are the order's parts."""
    gaps = quality.sequence_gaps(t("lineitem"), ["l_orderkey"], "l_linenumber").select("l_orderkey").distinct()
    parts = t("lineitem").join(gaps, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("related"))
    state = F.col("l_orderkey") % 3
    return parts.select(
        F.concat(F.lit("gap:"), "l_orderkey").alias("stable_key"),
        "related",
        F.sha2(F.array_join(F.transform("related", lambda x: x.cast("string")), ","), 256).alias("fingerprint"),
        F.when(F.col("l_orderkey") % 5 == 0, "STALE").otherwise("ACTIVE").alias("lifecycle"),
        F.when(state == 0, "PENDING").when(state == 1, "CONFIRMED").otherwise("DISMISSED").alias("review"),
        F.col("l_orderkey").alias("k"),
    )


SIGNALS = """
    WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), g AS (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS b FROM d),
    s AS (SELECT 'gap:' || l_orderkey AS stable_key, list_sort(list_distinct(list(l_partkey))) AS related, l_orderkey AS k,
            CASE WHEN l_orderkey % 5 = 0 THEN 'STALE' ELSE 'ACTIVE' END AS lifecycle,
            CASE l_orderkey % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'CONFIRMED' ELSE 'DISMISSED' END AS review
          FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM g WHERE l_linenumber > b + 1) GROUP BY l_orderkey),
    f AS (SELECT *, sha256(array_to_string(related, ',')) AS fingerprint FROM s)"""


@family.query(
    "qlt11_signal_upsert",
    SIGNALS + """
    SELECT stable_key, CASE WHEN k % 4 = 0 THEN sha256(fingerprint) ELSE fingerprint END AS fingerprint, CASE WHEN k % 4 = 3 AND review = 'PENDING' THEN 'STALE' ELSE 'ACTIVE' END AS lifecycle,
        CASE WHEN k % 4 = 0 THEN 'PENDING' ELSE review END AS review FROM f""",
)
def _(t):
    old = _signals(t)
    new = old.filter("k % 4 <> 3").withColumn("fingerprint", F.when(F.col("k") % 4 == 0, F.sha2("fingerprint", 256)).otherwise(F.col("fingerprint")))
    return quality.upserted_signals(old, new)


@family.query(
    "qlt12_review_overview",
    SIGNALS + " SELECT lifecycle, review, count(DISTINCT stable_key) AS signals, count(DISTINCT c) AS chunks FROM (SELECT lifecycle, review, stable_key, unnest(related) AS c FROM f) GROUP BY 1, 2",
)
def _(t):
    return quality.review_overview(_signals(t).withColumn("related_chunk_ids", F.to_json("related")))


@family.query(
    "qlt13_chunk_review_status",
    SIGNALS + """,
    e AS (SELECT unnest(related) AS c, review, lifecycle FROM f),
    r AS (SELECT c, bool_or(review = 'PENDING') AS p, bool_or(review = 'CONFIRMED') AS k, bool_or(lifecycle = 'STALE') AS s, count(*) AS n FROM e GROUP BY 1)
    SELECT p_partkey AS chunk_id, coalesce(n, 0) AS n_signals, CASE WHEN n IS NULL THEN 'CLEAN' WHEN p AND k THEN 'PARTLY_CONFIRMED' WHEN p AND s THEN 'PENDING_STALE' WHEN p THEN 'PENDING' WHEN k THEN 'CONFIRMED' WHEN s THEN 'STALE' ELSE 'DISMISSED' END AS review_status
    FROM part LEFT JOIN r ON c = p_partkey""",
)
def _(t):
    signals = _signals(t).select(F.explode("related").alias("chunk_id"), "review", "lifecycle")
    return quality.chunk_review_status(t("part").select(F.col("p_partkey").alias("chunk_id")), signals)


@family.query(
    "qlt14_stale_by_change",
    SIGNALS + " SELECT stable_key, CASE WHEN len(list_filter(related, lambda x: x % 50 = 0)) > 0 THEN 'STALE' ELSE lifecycle END AS lifecycle FROM f",
)
def _(t):
    changed = t("part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("chunk_id"))
    return quality.stale_by_change(_signals(t), changed).select("stable_key", "lifecycle")


@family.query("qlt07_determinism", r"SELECT count(*) FILTER (regexp_matches(text, '\S')) AS documents, CAST(0 AS BIGINT) AS differ FROM documents")
def _(t):
    """Documents whose chunk signatures differ between two evaluations: none."""
    from lexstrata.operators import chunking

    one = quality.signature(chunking.paragraph_chunks(t("documents")), "doc_id", "chunk_index", "content")
    two = quality.signature(chunking.paragraph_chunks(t("documents").repartition(3)), "doc_id", "chunk_index", "content")
    both = one.join(two.withColumnRenamed("signature", "again"), "doc_id", "full")
    return both.agg(F.count("*").alias("documents"), F.count_if(~F.col("signature").eqNullSafe(F.col("again"))).alias("differ"))


