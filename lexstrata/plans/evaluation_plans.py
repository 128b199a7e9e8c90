"""Evaluation of each stage of the ranking chain against gold chunks found by shared word 8-grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.functions.text import words
from lexstrata.operators import evaluation, ranking
from lexstrata.plans import ranking_plans as chain
from lexstrata.plans.base import Family
from lexstrata.plans.ranking_plans import HITS, OVERLAP, covered_sql
from lexstrata.plans.retrieval_plans import keyword_hits
from lexstrata.sources.scratch import materialised

family = Family()
QUERIES, ORACLES = family.QUERIES, family.ORACLES

GRAM = 8
#: Items with so many n-grams at most are repeated to the documents, others are shuffled.
MOST_GRAMS = 500_000
STAGES = [(1, "RAW_RECALL"), (2, "Fusion"), (3, "Rerank"), (4, "LexicalCoverage"), (5, "EvidenceGate"), (6, "FINAL_EVIDENCE")]
#: The best score that a question needs to keep its evidence.
GATE = 0.7

#: A document is gold for an item if they share a word 8-gram; its grade is the share of the item's 8-grams, from 1 to 3.
#: Gold of one source is one group of evidence, so an item whose gold comes from several sources is a compound one.
GOLD = r"""
    iw AS (SELECT item_id AS case_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
    dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
    ig AS (SELECT DISTINCT case_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM iw),
    dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM dw),
    gn AS (SELECT case_id, count(*) AS n FROM ig GROUP BY 1),
    gold AS (SELECT case_id, doc_id AS chunk_id, CAST(1 + floor(2.0 * count(*) / any_value(n)) AS INTEGER) AS relevance, any_value(source) AS group_id FROM ig JOIN dg USING (g) JOIN gn USING (case_id) JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY 1, 2),
    cs AS (SELECT item_id AS case_id, item_id IN (SELECT case_id FROM gold) AS answerable, CASE WHEN item_id NOT IN (SELECT case_id FROM gold) THEN 'UNANSWERABLE' WHEN item_id IN (SELECT case_id FROM gold GROUP BY 1 HAVING count(DISTINCT group_id) > 1) THEN 'COMPOUND' WHEN regexp_matches(text, '[0-9]') THEN 'NUMERIC' ELSE 'SINGLE_CLAUSE' END AS bucket FROM benchmark)"""
RANKS = f"""{HITS}, {OVERLAP}, {covered_sql('true')}, {GOLD},
    gq AS (SELECT query_id FROM rr GROUP BY 1 HAVING max(rerank_score) >= {GATE}),
    fe AS (SELECT query_id, key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, key) AS INTEGER) AS rank FROM rr WHERE query_id IN (SELECT query_id FROM gq) AND trim(text, ' ') <> ''),
    rw AS (SELECT query_id, key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY min(rank), key) AS INTEGER) AS rank FROM hits GROUP BY 1, 2),
    rk AS (SELECT query_id AS case_id, 'RAW_RECALL' AS stage, key AS chunk_id, rank FROM rw UNION ALL SELECT query_id, 'Fusion', key, place FROM fu UNION ALL SELECT query_id, 'Rerank', key, rank FROM rr
           UNION ALL SELECT query_id, 'LexicalCoverage', key, rank FROM lc UNION ALL SELECT query_id, 'EvidenceGate', key, rank FROM lc WHERE query_id IN (SELECT query_id FROM gq) UNION ALL SELECT query_id, 'FINAL_EVIDENCE', key, rank FROM fe),
    sg AS (SELECT * FROM (VALUES (1, 'RAW_RECALL'), (2, 'Fusion'), (3, 'Rerank'), (4, 'LexicalCoverage'), (5, 'EvidenceGate'), (6, 'FINAL_EVIDENCE')) AS s(place, stage)),
    hb AS (SELECT case_id, stage, min(rank) AS best, count(*) FILTER (rank <= 5) AS in5 FROM rk JOIN gold USING (case_id, chunk_id) GROUP BY 1, 2),
    ng AS (SELECT case_id, count(*) AS n_gold FROM gold GROUP BY 1),
    al AS (SELECT * FROM cs JOIN sg ON true JOIN ng USING (case_id) LEFT JOIN hb USING (case_id, stage) WHERE answerable)"""
METRICS = """count(*) AS cases, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_5,
    round(avg(coalesce(in5, 0) / n_gold), 6) AS recall_5, round(avg(CASE WHEN best <= 5 THEN CAST(1.0 AS DOUBLE) / best ELSE 0.0 END), 6) AS mrr_5, round(avg(CASE WHEN best <= 20 THEN CAST(1.0 AS DOUBLE) / best ELSE 0.0 END), 6) AS mrr_20"""


def _grams(df, id_col, text_col="text"):
    """Distinct word n-grams."""
    w, n = F.col("_w"), F.size("_w")
    grams = F.when(n >= GRAM, F.transform(F.sequence(F.lit(1), n - (GRAM - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(GRAM)), " ")))
    return df.select(id_col, words(F.col(text_col)).alias("_w")).select(id_col, F.explode(F.array_distinct(grams)).alias("g"))


def gold(t):
    """Written once for a query, which reads it several times."""
    if not hasattr(t, "_gold"):
        t._gold = materialised(_gold(t), "gold")
    return t._gold


def _gold(t):
    items = _grams(t("benchmark").withColumnRenamed("item_id", "case_id"), "case_id")
    docs = _grams(t("documents").withColumnRenamed("doc_id", "chunk_id"), "chunk_id")
    if items.limit(MOST_GRAMS + 1).count() <= MOST_GRAMS:  # then the documents' n-grams stay where they are
        items = F.broadcast(items)
    n = items.groupBy("case_id").agg(F.count("*").alias("n"))
    shared = items.join(docs, "g").groupBy("case_id", "chunk_id").agg(F.count("*").alias("k"))
    graded = shared.join(n, "case_id").select("case_id", "chunk_id", (1 + F.floor(2.0 * F.col("k") / F.col("n"))).cast("int").alias("relevance"))
    return graded.join(t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("group_id")), "chunk_id")


def cases(t):
    groups = gold(t).groupBy("case_id").agg(F.count_distinct("group_id").alias("n"))
    rows = t("benchmark").select(F.col("item_id").alias("case_id"), "text").join(groups, "case_id", "left")
    bucket = F.when(F.col("n").isNull(), "UNANSWERABLE").when(F.col("n") > 1, "COMPOUND").when(F.col("text").rlike("[0-9]"), "NUMERIC").otherwise("SINGLE_CLAUSE")
    return rows.select("case_id", F.col("n").isNotNull().alias("answerable"), bucket.alias("bucket"))


def ranks(t):
    """``case_id, stage, chunk_id, rank`` of every stage of the chain; written once for a query, which reads it several times."""
    if not hasattr(t, "_ranks"):
        t._ranks = materialised(_ranks(t), "stage-ranks")
    return t._ranks


def _ranks(t):
    order = Window.partitionBy("query_id").orderBy("_o", "key")
    raw = chain.hits(t).groupBy("query_id", "key").agg(F.min("rank").alias("_o")).withColumn("rank", F.row_number().over(order))
    fused, best = materialised(chain.fused(t), "fused"), materialised(chain.reranked(t), "reranked")
    topped = chain.covered(t, best.select("query_id", "key", "rank"))
    passed = ranking.evidence_gate(best, least=GATE)
    final = passed.select("query_id", "rank", "key", F.col("key").alias("doc_id"), F.col("rerank_score").alias("score"), "text")
    lists = {
        "RAW_RECALL": raw,
        "Fusion": fused.withColumnRenamed("place", "rank"),
        "Rerank": best,
        "LexicalCoverage": topped,
        "EvidenceGate": topped.join(passed.select("query_id").distinct(), "query_id", "left_semi"),
        "FINAL_EVIDENCE": ranking.best_per_document(final, needs_text=True).drop("rank").withColumnRenamed("number", "rank"),
    }
    one = lambda stage, df: df.select(F.col("query_id").alias("case_id"), F.lit(stage).alias("stage"), F.col("key").alias("chunk_id"), "rank")
    return reduce(DataFrame.unionByName, [one(stage, df) for stage, df in lists.items()])


def stages(t):
    return t.spark.createDataFrame(STAGES, "place int, stage string")


@family.query(
    "evl01_stage_ranks",
    """
    WITH p AS (SELECT conv_id AS case_id, turn AS sub, CAST(unnest(range(0, len(string_split(text, ' ')))) AS INTEGER) AS pos, unnest(string_split(text, ' ')) AS chunk_id FROM conversations WHERE role = 'user'),
    f AS (SELECT case_id, chunk_id, min((sub, pos)) AS o FROM p GROUP BY 1, 2)
    SELECT case_id, 'words' AS stage, chunk_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY o) AS INTEGER) AS rank FROM f""",
)
def _(t):
    lists = t("conversations").filter("role = 'user'").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("sub"), F.lit("words").alias("stage"), F.split("text", " ").alias("ids"))
    return evaluation.stage_ranks(lists)


@family.query("evl02_first_gold_rank", f"{RANKS} SELECT case_id, stage, min(rank) AS first_rank FROM rk JOIN gold USING (case_id, chunk_id) WHERE rank <= 5 GROUP BY 1, 2")
def _(t):
    return evaluation.first_gold_rank(ranks(t), gold(t), 5)


@family.query("evl03_basic_metrics", f"{RANKS} SELECT stage, {METRICS} FROM al GROUP BY stage")
def _(t):
    return evaluation.basic_metrics(cases(t), stages(t), ranks(t), gold(t), ["stage"])


@family.query(
    "evl04_compound_metrics",
    f"""{RANKS},
    tp AS (SELECT case_id, chunk_id, rank FROM rk WHERE stage = 'RAW_RECALL' AND rank <= 5),
    gf AS (SELECT case_id, group_id, bool_or(rank IS NOT NULL) AS found FROM gold LEFT JOIN tp USING (case_id, chunk_id) GROUP BY 1, 2),
    pc AS (SELECT case_id, bool_and(found) AS all_groups, avg(CAST(found AS INTEGER)) AS recall FROM gf GROUP BY 1),
    dc AS (SELECT case_id, sum((pow(2.0, relevance) - 1) / log2(rank + 1)) AS dcg FROM tp JOIN gold USING (case_id, chunk_id) GROUP BY 1),
    id AS (SELECT case_id, sum((pow(2.0, relevance) - 1) / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY relevance DESC, chunk_id) AS r FROM gold) WHERE r <= 5 GROUP BY 1)
    SELECT case_id, all_groups, round(recall, 6) AS group_recall, round(1 - recall, 6) AS missing_groups, round(coalesce(dcg / idcg, 0.0), 6) AS ndcg FROM pc LEFT JOIN dc USING (case_id) LEFT JOIN id USING (case_id)""",
)
def _(t):
    return evaluation.compound_metrics(ranks(t).filter("stage = 'RAW_RECALL'"), gold(t))


@family.query("evl05_buckets_by_stage", f"{RANKS} SELECT bucket, stage, {METRICS} FROM al GROUP BY bucket, stage")
def _(t):
    return evaluation.basic_metrics(cases(t), stages(t), ranks(t), gold(t), ["bucket", "stage"])


@family.query(
    "evl05_report",
    f"""{RANKS},
    rt AS (SELECT case_id, stage, count(*) AS returned FROM rk GROUP BY 1, 2),
    ev AS (SELECT cs.bucket, sg.stage, answerable, best, in5, n_gold, returned FROM cs JOIN sg ON true LEFT JOIN ng USING (case_id) LEFT JOIN hb USING (case_id, stage) LEFT JOIN rt USING (case_id, stage))
    SELECT bucket, stage, CASE grouping(bucket) * 2 + grouping(stage) WHEN 0 THEN 'cell' WHEN 1 THEN 'bucket' WHEN 2 THEN 'stage' ELSE 'run' END AS level,
        count(*) AS cases, count(*) FILTER (answerable) AS answerable, round(avg(CASE WHEN returned > 0 THEN 0.0 ELSE 1.0 END), 6) AS empty,
        round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0.0 END) FILTER (answerable), 6) AS hit_1, round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0.0 END) FILTER (answerable), 6) AS hit_5,
        round(avg(coalesce(in5, 0) / n_gold) FILTER (answerable), 6) AS recall_5,
        round(avg(CASE WHEN best <= 5 THEN CAST(1.0 AS DOUBLE) / best ELSE 0.0 END) FILTER (answerable), 6) AS mrr_5, round(avg(CASE WHEN best <= 20 THEN CAST(1.0 AS DOUBLE) / best ELSE 0.0 END) FILTER (answerable), 6) AS mrr_20
    FROM ev GROUP BY GROUPING SETS ((bucket, stage), (bucket), (stage), ())""",
)
def _(t):
    return evaluation.bucket_report(cases(t), stages(t), ranks(t), gold(t))


@family.query(
    "evl06_unanswerable",
    f"""{RANKS}, e AS (SELECT case_id, count(*) FILTER (score >= 12) AS n, count(*) FILTER (score >= 15) AS c FROM cs LEFT JOIN kw ON query_id = case_id WHERE NOT answerable GROUP BY 1)
    SELECT count(*) AS cases, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS correct_empty, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS false_evidence, round(avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END), 6) AS false_citation FROM e""",
)
def _(t):
    results = keyword_hits(t).groupBy(F.col("query_id").alias("case_id")).agg(F.count_if(F.col("score") >= 12).alias("n_evidence"), F.count_if(F.col("score") >= 15).alias("n_citations"))
    return evaluation.unanswerable_metrics(cases(t), results)


@family.query(
    "evl07_funnel",
    f"""{RANKS}, r AS (SELECT place, stage, round(avg(CASE WHEN best IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit_rate FROM al GROUP BY 1, 2)
    SELECT place, stage, hit_rate, round(lag(hit_rate) OVER (ORDER BY place) - hit_rate, 6) AS loss FROM r""",
)
def _(t):
    return evaluation.funnel(cases(t), stages(t), ranks(t), gold(t))


@family.query("evl08_recomputed", f"{RANKS} SELECT stage, {METRICS} FROM al GROUP BY stage")
def _(t):
    """Saved lists of all cases, joined with the manifest again and measured without another search."""
    saved = ranks(t).groupBy("case_id", "stage").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("l"))
    lists = saved.select("case_id", "stage", F.lit(0).alias("sub"), F.transform("l", lambda x: x["chunk_id"]).alias("ids"))
    again = evaluation.stage_ranks(lists.join(cases(t).select("case_id"), "case_id"))
    return evaluation.basic_metrics(cases(t), stages(t), again, gold(t), ["stage"])


@family.query(
    "evl09_gates",
    f"""{RANKS}, m AS (SELECT stage || ' hit_5' AS metric, round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0.0 END), 6) AS value FROM al GROUP BY stage)
    SELECT metric, value, coalesce(value IS NOT NULL AND (lo IS NULL OR value >= lo) AND (hi IS NULL OR value <= hi), false) AS passed
    FROM (VALUES ('RAW_RECALL hit_5', 0.5, NULL), ('FINAL_EVIDENCE hit_5', 0.99, NULL), ('Fusion hit_5', NULL, 0.1), ('other', 0.1, NULL)) AS t(metric, lo, hi) LEFT JOIN m USING (metric)""",
)
def _(t):
    found = evaluation.basic_metrics(cases(t), stages(t), ranks(t), gold(t), ["stage"]).select(F.concat("stage", F.lit(" hit_5")).alias("metric"), F.col("hit_5").alias("value"))
    limits = [("RAW_RECALL hit_5", 0.5, None), ("FINAL_EVIDENCE hit_5", 0.99, None), ("Fusion hit_5", None, 0.1), ("other", 0.1, None)]
    return evaluation.gates(found, t.spark.createDataFrame(limits, "metric string, at_least double, at_most double"))


@family.query(
    "evl10_label_metrics",
    """
    WITH s AS (SELECT source, CASE WHEN quality = 1 THEN ['good'] ELSE ['poor'] END AS e, CASE WHEN toxic = 0 THEN ['toxic'] ELSE [] END AS f,
        list_filter([CASE WHEN n_chars > 500 THEN 'good' ELSE 'poor' END, CASE WHEN n_chars % 7 = 0 THEN 'toxic' END], lambda x: x IS NOT NULL) AS p, n_chars < 100 AS m FROM documents JOIN labels USING (doc_id))
    SELECT source, round(sum(len(list_intersect(e, p))) / sum(len(e)), 6) AS recall, round(sum(len(list_intersect(e, p))) / sum(len(p)), 6) AS precision,
        round(CASE WHEN sum(len(f)) > 0 THEN sum(len(list_intersect(f, p))) / sum(len(f)) END, 6) AS forbidden_rate, round(avg(CASE WHEN m THEN 1.0 ELSE 0.0 END), 6) AS manual_rate FROM s GROUP BY source""",
)
def _(t):
    rows = t("documents").join(t("labels"), "doc_id")
    none = F.array().cast("array<string>")
    samples = rows.select(
        "source",
        F.when(F.col("quality") == 1, F.array(F.lit("good"))).otherwise(F.array(F.lit("poor"))).alias("expected"),
        F.when(F.col("toxic") == 0, F.array(F.lit("toxic"))).otherwise(none).alias("forbidden"),
        F.array_compact(F.array(F.when(F.col("n_chars") > 500, "good").otherwise("poor"), F.when(F.col("n_chars") % 7 == 0, "toxic"))).alias("predicted"),
        (F.col("n_chars") < 100).alias("manual"),
    )
    return evaluation.label_metrics(samples, "source")


@family.query(
    "evl11_manifest_checks",
    "SELECT count(*) = 1000 AS right_count, count(*) = count(DISTINCT doc_id) AS unique_ids, count(*) FILTER (lang NOT IN ('en', 'fr', 'de')) = 0 AS allowed_sources FROM documents",
)
def _(t):
    return evaluation.manifest_checks(t("documents"), "doc_id", "lang", 1000, ["en", "fr", "de"])


@family.query(
    "evl12_criterion_verdicts",
    """
    WITH v AS (SELECT user_id, event_type, CASE WHEN event_type = 'signup' THEN 'NOT_OBSERVABLE' WHEN event_id % 50 = 0 THEN 'UNCERTAIN' WHEN value < 300 THEN 'PASS' ELSE 'FAIL' END AS v FROM events)
    SELECT user_id, event_type, CASE WHEN bool_or(v = 'FAIL') THEN 'FAIL' WHEN bool_and(v = 'PASS') THEN 'PASS' WHEN bool_and(v = 'NOT_OBSERVABLE') THEN 'NOT_OBSERVABLE' ELSE 'UNCERTAIN' END AS suggestion,
        round(avg(CASE WHEN v IN ('PASS', 'FAIL') THEN 1.0 ELSE 0.0 END), 6) AS confidence FROM v GROUP BY 1, 2""",
)
def _(t):
    criteria = t("events").select(F.struct("user_id", "event_type").alias("case"), (F.col("event_type") != "signup").alias("observable"), (F.col("event_id") % 50).alias("evidence"), (F.col("value") < 300).alias("met"))
    return evaluation.criterion_verdicts(criteria, "case").select("case.*", "suggestion", "confidence")


