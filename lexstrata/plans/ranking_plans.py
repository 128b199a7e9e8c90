"""The ranking chain over keyword and vector lists, and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexstrata.functions import text
from lexstrata.functions.text import words
from lexstrata.operators import keyword, ranking, vectors
from lexstrata.plans.base import Family, Tables
from lexstrata.plans.retrieval_plans import BM25, keyword_hits
from lexstrata.plans.text_plans import ANCHORS
from lexstrata.sources.scratch import materialised

family = Family()
QUERIES, ORACLES = family.QUERIES, family.ORACLES

#: Keyword hits of each benchmark item, and the documents with the nearest hashed word vectors.
HITS = rf"""WITH {BM25},
    hw AS (SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS x FROM documents
        UNION ALL SELECT 'q', item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) FROM benchmark),
    hd AS (SELECT side, id, substr(md5(x), 1, 2) AS d, ln(1 + count(*)) AS w FROM hw GROUP BY 1, 2, 3),
    hn AS (SELECT side, id, sqrt(sum(w * w)) AS n FROM hd GROUP BY 1, 2),
    hs AS (SELECT q.id AS query_id, p.id AS doc_id, sum(q.w * p.w) AS s FROM hd q JOIN hd p USING (d) WHERE q.side = 'q' AND p.side = 'd' GROUP BY 1, 2),
    hc AS (SELECT query_id, doc_id, round(s / (a.n * b.n), 6) AS score FROM hs JOIN hn a ON a.side = 'q' AND a.id = query_id JOIN hn b ON b.side = 'd' AND b.id = doc_id),
    v AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM hc),
    hits AS (SELECT query_id, 'keyword' AS channel, doc_id AS key, rank, score FROM kw UNION ALL SELECT query_id, 'vector', doc_id, rank, score FROM v WHERE rank <= 20),
    dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY CASE channel WHEN 'vector' THEN 0 ELSE 1 END, rank) AS r FROM hits) WHERE r = 1),
    fz AS (SELECT query_id, key, CAST(sum(CASE channel WHEN 'keyword' THEN 1.0 ELSE 0.5 END / (20 + rank)) AS FLOAT) AS score, min(CASE channel WHEN 'vector' THEN rank ELSE 100 + rank END) AS f FROM hits GROUP BY 1, 2),
    fu AS (SELECT query_id, key, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f, key) AS INTEGER) AS place FROM fz) WHERE place <= 20)"""

OVERLAP = r"""
    qw AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM benchmark),
    ov AS (SELECT fu.*, d.text, d.source, round(0.85 * len(list_filter(w, lambda x: contains(lower(d.text), x))) / len(w) + 0.15 * least(1.0, CAST(score AS DOUBLE)), 6) AS rerank_score FROM fu JOIN documents d ON d.doc_id = key JOIN qw USING (query_id)),
    rr AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, place) AS INTEGER) AS rank FROM ov) WHERE rank <= 5)"""


def hits(t: Tables):
    """Written once for a query, which may read it several times."""
    if not hasattr(t, "_hits"):
        t._hits = _hits(t)
    return t._hits


def _hits(t: Tables):
    kw = keyword_hits(t).select("query_id", F.lit("keyword").alias("channel"), F.col("doc_id").alias("key"), "rank", "score")
    vector = lambda table, key, name: vectors.hashed_vectors(t(table).withColumnRenamed(key, name), name, words(F.col("text")))
    near = vectors.exact_top_k(vector("benchmark", "item_id", "query_id"), vector("documents", "doc_id", "vec_id"), 20, n_points=t("documents").count())
    return materialised(kw.unionByName(near.select("query_id", F.lit("vector").alias("channel"), F.col("vec_id").alias("key"), "rank", "score")), "hits")


def fused(t: Tables):
    return ranking.fused(hits(t), {"keyword": 1.0, "vector": 0.5})


def reranked(t: Tables):
    texts = t("documents").select(F.col("doc_id").alias("key"), "text", "source")
    questions = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    rows = fused(t).join(texts, "key").join(questions, "query_id").withColumn("prior", F.col("score").cast("double"))
    return ranking.reranked(rows, keyword.term_overlap("question", "text", "prior"))


@family.query("pst01_deduplicate", f"{HITS} SELECT query_id, channel, key, rank FROM dd")
def _(t):
    return ranking.deduplicated(hits(t)).select("query_id", "channel", "key", "rank")


@family.query("pst02_fusion", f"{HITS} SELECT query_id, key, round(CAST(score AS DOUBLE), 6) AS score, place FROM fu")
def _(t):
    return fused(t).withColumn("score", F.round(F.col("score").cast("double"), 6))


@family.query(
    "pst03_attribution",
    f"""{HITS}, a AS (SELECT channel, count(*) AS kept FROM hits SEMI JOIN fu USING (query_id, key) GROUP BY 1)
    SELECT channel, count(*) AS found, coalesce(any_value(kept), 0) AS kept FROM hits LEFT JOIN a USING (channel) GROUP BY 1""",
)
def _(t):
    return ranking.attribution_counts(fused(t), hits(t))


@family.query("pst04_rerank", f"{HITS}, {OVERLAP} SELECT query_id, key, rerank_score, rank FROM rr")
def _(t):
    return reranked(t).select("query_id", "key", "rerank_score", "rank")


def covered_sql(selected: str) -> str:
    """``lc``: ``rr`` rows that ``selected`` keeps, topped up to five by lexical coverage."""
    return f"""
    ls AS (SELECT query_id, key, rank FROM rr WHERE {selected}),
    lw AS (SELECT unnest(['the', 'tion', 'ing', 'und', 'que']) AS a),
    lh AS (SELECT query_id, key, rank, count(*) FILTER (contains(b.text, a) AND contains(d.text, a)) AS shared FROM hits JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = key CROSS JOIN lw GROUP BY query_id, channel, key, rank),
    lg AS (SELECT query_id, key, max(shared) AS shared, min(rank) AS rank FROM lh WHERE shared >= 2 GROUP BY 1, 2),
    lx AS (SELECT lg.*, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, rank, key) AS o FROM lg ANTI JOIN ls USING (query_id, key)),
    ln AS (SELECT query_id, count(*) AS n FROM ls GROUP BY 1),
    la AS (SELECT lx.query_id, key, CAST(CASE WHEN n >= 5 THEN 5 ELSE n + o END AS INTEGER) AS rank, n >= 5 AS over FROM lx JOIN ln USING (query_id) WHERE o <= 5 - n OR (n >= 5 AND o = 1)),
    lc AS (SELECT query_id, key, rank FROM ls WHERE rank < 5 OR query_id NOT IN (SELECT query_id FROM la WHERE over) UNION ALL SELECT query_id, key, rank FROM la)"""


def covered(t: Tables, selected):
    """Rows ``query_id, key, rank`` topped up by lexical coverage."""
    texts = t("documents").select(F.col("doc_id").alias("key"), "text")
    questions = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    found = hits(t).select("query_id", "key", "rank").join(texts, "key").join(questions, "query_id")
    return ranking.coverage_top_up(selected, found.withColumn("shared", text.anchor_count(ANCHORS, F.col("question"), F.col("text"))), "shared")


@family.query("pst05_coverage_top_up", f"{HITS}, {OVERLAP}, {covered_sql('query_id % 2 = 0 OR rank <= 3')} SELECT query_id, key, rank FROM lc")
def _(t):
    return covered(t, reranked(t).filter("query_id % 2 = 0 or rank <= 3").select("query_id", "key", "rank"))


@family.query("pst06_evidence_gate", f"{HITS}, {OVERLAP}, m AS (SELECT *, max(rerank_score) OVER (PARTITION BY query_id) AS best FROM rr) SELECT query_id, key, rank FROM m WHERE best >= 0.7")
def _(t):
    return ranking.evidence_gate(reranked(t), least=0.7).select("query_id", "key", "rank")


@family.query(
    "pst07_enrichment",
    f"{HITS} SELECT query_id, fu.key, CASE WHEN fu.key % 3 = 0 THEN -1 ELSE fu.key END AS doc_id, CASE WHEN fu.key % 3 = 0 THEN NULL ELSE CAST(0 AS INTEGER) END AS chunk_index, CASE WHEN fu.key % 3 = 0 THEN 'unnamed' ELSE d.source END AS doc_name FROM fu JOIN documents d ON d.doc_id = fu.key",
)
def _(t):
    rows = fused(t).select("query_id", "key", F.lit(-1).cast("long").alias("doc_id"), F.lit("unnamed").alias("doc_name"))
    chunks = t("documents").filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("key"), "doc_id", F.lit(0).alias("chunk_index"))
    names = t("documents").select("doc_id", F.col("source").alias("doc_name"))
    return ranking.enriched(rows, chunks, names).select("query_id", "key", "doc_id", "chunk_index", "doc_name")


@family.query(
    "pst08_stage_trace",
    f"""{HITS}, {OVERLAP}, r AS (SELECT query_id, key, min(rank) AS o FROM hits GROUP BY 1, 2)
    SELECT query_id, 'RAW_RECALL' AS stage, list(key ORDER BY o, key) AS keys FROM r GROUP BY 1
    UNION ALL SELECT query_id, 'Fusion', list(key ORDER BY place) FROM fu GROUP BY 1 UNION ALL SELECT query_id, 'Rerank', list(key ORDER BY rank) FROM rr GROUP BY 1""",
)
def _(t):
    return ranking.stage_trace({"RAW_RECALL": hits(t), "Fusion": fused(t).withColumnRenamed("place", "rank"), "Rerank": reranked(t)})


COLLECTIONS = "SELECT query_id, key, source AS collection FROM fu JOIN documents ON doc_id = key"


@family.query(
    "pst09_intent_groups",
    f"""{HITS}, r AS ({COLLECTIONS})
    SELECT query_id, CASE WHEN CAST(substr(collection, 4) AS INTEGER) % 2 = 0 THEN 'intent ' || collection ELSE 'multi_channel' END AS intent, list_sort(list_distinct(list(key))) AS keys FROM r GROUP BY 1, 2""",
)
def _(t):
    rows = fused(t).join(t("documents").select(F.col("doc_id").alias("key"), F.col("source").alias("collection")), "key")
    even = t("documents").select(F.col("source").alias("collection")).distinct().filter("cast(substr(collection, 4) as int) % 2 = 0")
    queries = t("benchmark").select(F.col("item_id").alias("query_id"), F.lit(1).alias("one"))
    intents = even.withColumn("one", F.lit(1)).join(queries, "one").select("query_id", "collection", F.concat(F.lit("intent "), "collection").alias("intent"))
    return ranking.grouped_by_intent(rows, intents)


@family.query(
    "pst10_eligible_intents",
    f"""{HITS}, r AS ({COLLECTIONS}), i AS (SELECT DISTINCT item_id AS query_id, source AS collection, 'intent ' || source AS intent, item_id % 2 = 0 AS directed FROM benchmark, (SELECT DISTINCT source FROM documents))
    SELECT query_id, intent, directed FROM i WHERE NOT directed OR (query_id, collection) IN (SELECT (query_id, collection) FROM r)""",
)
def _(t):
    rows = fused(t).join(t("documents").select(F.col("doc_id").alias("key"), F.col("source").alias("collection")), "key")
    pairs = vectors.every_pair(t("benchmark").select(F.col("item_id").alias("query_id")), t("documents").select("source").distinct())
    intents = pairs.select("query_id", F.col("source").alias("collection"), F.concat(F.lit("intent "), "source").alias("intent"), (F.col("query_id") % 2 == 0).alias("directed"))
    return ranking.eligible_intents(intents, rows).select("query_id", "intent", "directed")


@family.query(
    "pst11_direct_evidence",
    f"""{HITS} SELECT query_id, key FROM fu JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = key
    WHERE (contains(b.text, 'wh') AND contains(regexp_replace(d.text, '\\s+', '', 'g'), 'wh')) OR (contains(b.text, 'q') AND contains(regexp_replace(d.text, '\\s+', '', 'g'), 'q'))""",
)
def _(t):
    texts = t("documents").select(F.col("doc_id").alias("key"), "text")
    questions = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return ranking.direct_evidence(fused(t).join(texts, "key").join(questions, "query_id"), "question", "text", ["wh", "q"]).select("query_id", "key")


@family.query(
    "pst12_numbered_evidence",
    f"{HITS} SELECT query_id, key, place AS number, 'evidence-' || place AS evidence_id, source || ' no. ' || key AS reference FROM fu JOIN documents ON doc_id = key",
)
def _(t):
    rows = fused(t).join(t("documents").select(F.col("doc_id").alias("key"), "source"), "key")
    return ranking.numbered_evidence(rows, ["place"]).select("query_id", "key", "number", "evidence_id", F.concat_ws(" no. ", "source", "key").alias("reference"))


SOURCES = """, b AS (SELECT query_id, source AS doc_id, max(rerank_score) AS score, arg_max(key, rerank_score * 1000000 - rank) AS key FROM rr WHERE {where} GROUP BY 1, 2),
    so AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS number FROM b)"""


def _by_source(t):
    return reranked(t).select("query_id", "rank", "key", F.col("source").alias("doc_id"), F.col("rerank_score").alias("score"), "text")


@family.query("pst13_best_per_document", f"{HITS}, {OVERLAP} {SOURCES.format(where='true')} SELECT query_id, doc_id, key, score, number FROM so")
def _(t):
    return ranking.best_per_document(_by_source(t)).select("query_id", "doc_id", "key", "score", "number")


@family.query("pst14_grounding", f"""{HITS}, {OVERLAP} {SOURCES.format(where="trim(text, ' ') <> ''")} SELECT query_id, doc_id, key, score, number FROM so WHERE number <= 3""")
def _(t):
    return ranking.best_per_document(_by_source(t), most=3, needs_text=True).select("query_id", "doc_id", "key", "score", "number")


CONTEXT = f"""{HITS}, {OVERLAP} {SOURCES.format(where='true')},
    g AS (SELECT rr.query_id, source, any_value(number) AS number, min(rank) AS first, string_agg(text, chr(10) ORDER BY rr.key % 7, rank) AS t FROM rr JOIN so ON so.query_id = rr.query_id AND so.doc_id = source GROUP BY 1, 2)
    SELECT query_id, string_agg(concat('[', number, '] ', t), chr(10) || chr(10) ORDER BY first) AS context FROM g GROUP BY query_id"""


@family.query("pst15_context", CONTEXT)
def _(t):
    rows = _by_source(t)
    body = rows.select("query_id", "rank", "doc_id", (F.col("key") % 7).cast("int").alias("chunk_index"), "text")
    return ranking.assembled_context(body, ranking.best_per_document(rows))


@family.query(
    "pst16_citation_numbers",
    f"{HITS}, {OVERLAP} {SOURCES.format(where='true')} SELECT rr.query_id, rr.key, concat('[', number, '](#cite-', number, ')') AS citation FROM rr JOIN so ON so.query_id = rr.query_id AND so.doc_id = source",
)
def _(t):
    rows = _by_source(t)
    numbers = ranking.best_per_document(rows).select("query_id", "doc_id", "number")
    n = F.col("number").cast("string")
    return rows.join(numbers, ["query_id", "doc_id"]).select("query_id", "key", F.concat(F.lit("["), n, F.lit("](#cite-"), n, F.lit(")")).alias("citation"))


@family.query(
    "pst17_merged_contexts",
    """WITH f AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user' AND turn % 4 <> 2)
    SELECT conv_id AS question, string_agg(concat(n, '. ', text), chr(10) ORDER BY n) AS context FROM f GROUP BY 1""",
)
def _(t):
    users = t("conversations").filter("role = 'user'")
    return ranking.merged_contexts(users.select(F.col("conv_id").alias("question"), F.col("turn").alias("sub"), F.when(F.col("turn") % 4 != 2, F.col("text")).otherwise(" ").alias("context")))


@family.query(
    "pst18_bounded_input",
    """WITH b AS (SELECT source, doc_id, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
        CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS number FROM documents)
    SELECT source, doc_id, number, substr(text, 1, CAST(6000 - b AS BIGINT)) AS text FROM b WHERE b < 6000""",
)
def _(t):
    return ranking.bounded_input(t("documents").select("source", "doc_id", "text"), "source", ["doc_id"], "text").select("source", "doc_id", "number", "text")


@family.query(
    "pst19_fact_query",
    """SELECT event_id, concat('type: ', event_type, CASE WHEN user_id % 2 = 0 THEN concat('; user: ', user_id) ELSE '' END, '; ', event_type, ', ', 'seen') AS query, least(1.0, greatest(0.0, value / 100 - 0.1)) AS confidence FROM events""",
)
def _(t):
    user = F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(" ")
    query, sure = ranking.fact_query([("type", F.col("event_type")), ("user", user)], F.array("event_type", F.lit("seen"), "event_type"), F.col("value") / 100 - 0.1)
    return t("events").select("event_id", query.alias("query"), sure.alias("confidence"))


def flagship(t: Tables):
    """Questions to cited evidence: keyword and vector search over whole documents, rerank, gate, best document, sources."""
    rows = ranking.evidence_gate(reranked(t))
    shaped = rows.select("query_id", "rank", "key", F.col("key").alias("doc_id"), F.col("rerank_score").alias("score"), "text")
    best = ranking.best_per_document(shaped, needs_text=True)
    return best.join(t("documents").select("doc_id", "source", text.excerpt(F.col("text")).alias("excerpt")), "doc_id").select("query_id", "number", "doc_id", "source", "score", "excerpt")


@family.query(
    "flagship_cited_evidence",
    f"""{HITS}, {OVERLAP}, m AS (SELECT *, max(rerank_score) OVER (PARTITION BY query_id) AS best FROM rr),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, key) AS INTEGER) AS number FROM m WHERE best >= 0.2 AND trim(text, ' ') <> '')
    SELECT query_id, number, key AS doc_id, source, rerank_score AS score, CASE WHEN length(trim(text, ' ')) > 100 THEN substr(trim(text, ' '), 1, 97) || '...' ELSE trim(text, ' ') END AS excerpt FROM n""",
)
def _(t):
    return flagship(t)

