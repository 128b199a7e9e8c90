"""Retrieval evaluation: ranks of gold, hit rates, graded metrics, funnels and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stage_ranks(traces: DataFrame) -> DataFrame:
    """``case_id, stage, chunk_id, rank`` from sub-question lists ``case_id, sub, stage, ids``: in order, first place kept."""
    rows = traces.select("case_id", "stage", "sub", F.posexplode("ids").alias("pos", "chunk_id"))
    first = rows.groupBy("case_id", "stage", "chunk_id").agg(F.min(F.struct("sub", "pos")).alias("_o"))
    rank = F.row_number().over(Window.partitionBy("case_id", "stage").orderBy("_o"))
    return first.withColumn("rank", rank).drop("_o")


def first_gold_rank(ranks: DataFrame, gold: DataFrame, cut: int) -> DataFrame:
    """``case_id, stage, first_rank`` of the best gold chunk at or before ``cut``."""
    g = gold.select("case_id", "chunk_id").distinct()
    return ranks.filter(F.col("rank") <= cut).join(g, ["case_id", "chunk_id"]).groupBy("case_id", "stage").agg(F.min("rank").alias("first_rank"))


def basic_metrics(cases: DataFrame, stages: DataFrame, ranks: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """hit@1, hit@5, recall@5, MRR@5 and MRR@20 over answerable cases, by groups of ``by``.

    Every answerable case counts in every stage, found or not.
    """
    g = gold.select("case_id", "chunk_id").distinct()
    n = g.groupBy("case_id").agg(F.count("*").alias("n_gold"))
    hits = ranks.join(g, ["case_id", "chunk_id"]).groupBy("case_id", "stage").agg(F.min("rank").alias("best"), F.count_if(F.col("rank") <= 5).alias("in5"))
    rows = cases.filter("answerable").crossJoin(F.broadcast(stages)).join(n, "case_id").join(hits, ["case_id", "stage"], "left")  # stages: a handful of names
    r = F.col("best")
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.groupBy(*by).agg(
        F.count("*").alias("cases"),
        mean(F.when(r <= 1, 1.0).otherwise(0.0)).alias("hit_1"),
        mean(F.when(r <= 5, 1.0).otherwise(0.0)).alias("hit_5"),
        mean(F.coalesce("in5", F.lit(0)) / F.col("n_gold")).alias("recall_5"),
        mean(F.when(r <= 5, 1.0 / r).otherwise(0.0)).alias("mrr_5"),
        mean(F.when(r <= 20, 1.0 / r).otherwise(0.0)).alias("mrr_20"),
    )


def bucket_report(cases: DataFrame, stages: DataFrame, ranks: DataFrame, gold: DataFrame) -> DataFrame:
    """The report of a run in one pass: every bucket in every stage, and the totals of each stage, each bucket and the run.

    Returns ``bucket, stage, level, cases, answerable, empty, hit_1, hit_5,
    recall_5, mrr_5, mrr_20``.  ``level`` is ``cell``, ``stage``, ``bucket``
    or ``run``; a column that a total runs over is null.  ``empty`` is the
    share of cases to which the stage returns nothing, which is right for a
    case without an answer.  The graded columns count answerable cases alone
    and are null where there are none.
    """
    g = gold.select("case_id", "chunk_id").distinct().withColumn("_gold", F.lit(True))
    n = g.groupBy("case_id").agg(F.count("*").alias("n_gold"))
    found = ranks.join(g, ["case_id", "chunk_id"], "left").groupBy("case_id", "stage")
    hits = found.agg(F.min(F.when(F.col("_gold"), F.col("rank"))).alias("best"), F.count_if(F.col("_gold") & (F.col("rank") <= 5)).alias("in5"), F.count("*").alias("returned"))
    rows = cases.crossJoin(F.broadcast(stages)).join(n, "case_id", "left").join(hits, ["case_id", "stage"], "left")  # stages: a handful of names
    r, level = F.col("best"), F.grouping("bucket") * 2 + F.grouping("stage")
    mean = lambda c: F.round(F.avg(F.when(F.col("answerable"), c)), 6)
    sets = [["bucket", "stage"], ["bucket"], ["stage"], []]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], "bucket", "stage").agg(
        F.element_at(F.array(*map(F.lit, ("cell", "bucket", "stage", "run"))), (level + 1).cast("int")).alias("level"),
        F.count("*").alias("cases"),
        F.count_if("answerable").alias("answerable"),
        F.round(F.avg(F.when(F.col("returned") > 0, 0.0).otherwise(1.0)), 6).alias("empty"),
        mean(F.when(r <= 1, 1.0).otherwise(0.0)).alias("hit_1"),
        mean(F.when(r <= 5, 1.0).otherwise(0.0)).alias("hit_5"),
        mean(F.coalesce("in5", F.lit(0)) / F.col("n_gold")).alias("recall_5"),
        mean(F.when(r <= 5, 1.0 / r).otherwise(0.0)).alias("mrr_5"),
        mean(F.when(r <= 20, 1.0 / r).otherwise(0.0)).alias("mrr_20"),
    )


def compound_metrics(ranks: DataFrame, gold: DataFrame, cut: int = 5) -> DataFrame:
    """Graded metrics of each case: ``case_id, all_groups, group_recall, missing_groups, ndcg``.

    ``gold`` is ``case_id, group_id, chunk_id, relevance``; nDCG uses
    2^relevance - 1 over log2(rank + 1) within ``cut``.
    """
    top = ranks.filter(F.col("rank") <= cut)
    groups = gold.join(top.select("case_id", "chunk_id", F.lit(1).alias("hit")), ["case_id", "chunk_id"], "left").groupBy("case_id", "group_id").agg(F.bool_or(F.col("hit").isNotNull()).alias("found"))
    per = groups.groupBy("case_id").agg(F.bool_and("found").alias("all_groups"), F.avg(F.col("found").cast("double")).alias("recall"))
    grade = gold.groupBy("case_id", "chunk_id").agg(F.max("relevance").alias("rel"))
    gain = (F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col("r") + 1)
    dcg = top.join(grade, ["case_id", "chunk_id"]).withColumn("r", F.col("rank").cast("double")).groupBy("case_id").agg(F.sum(gain).alias("dcg"))
    ideal = grade.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("rel"), "chunk_id")).cast("double")).filter(F.col("r") <= cut)
    best = ideal.groupBy("case_id").agg(F.sum(gain).alias("idcg"))
    return per.join(dcg, "case_id", "left").join(best, "case_id", "left").select(
        "case_id",
        "all_groups",
        F.round("recall", 6).alias("group_recall"),
        F.round(1 - F.col("recall"), 6).alias("missing_groups"),
        F.round(F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)), 6).alias("ndcg"),
    )


def unanswerable_metrics(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Of cases without an answer: share with nothing returned, with false evidence, and with a false citation."""
    rows = cases.filter("not answerable").join(results.select("case_id", "n_evidence", "n_citations"), "case_id", "left")
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    n, c = F.coalesce("n_evidence", F.lit(0)), F.coalesce("n_citations", F.lit(0))
    return rows.agg(F.count("*").alias("cases"), rate(n == 0).alias("correct_empty"), rate(n > 0).alias("false_evidence"), rate(c > 0).alias("false_citation"))


def funnel(cases: DataFrame, stages: DataFrame, ranks: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of answerable cases with any gold in each stage ``stage, place``, and the loss to the stage before."""
    any_hit = ranks.join(gold.select("case_id", "chunk_id").distinct(), ["case_id", "chunk_id"]).select("case_id", "stage").distinct().withColumn("hit", F.lit(1.0))
    rows = cases.filter("answerable").crossJoin(F.broadcast(stages)).join(any_hit, ["case_id", "stage"], "left")  # stages: a handful of names
    rates = rows.groupBy("place", "stage").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("hit_rate"))
    before = F.lag("hit_rate").over(Window.partitionBy(F.lit(1)).orderBy("place"))  # one row a stage
    return rates.withColumn("loss", F.round(before - F.col("hit_rate"), 6))


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``metric, value, passed`` of long metrics against ``metric, at_least, at_most``; a missing value fails."""
    inside = (F.col("at_least").isNull() | (F.col("value") >= F.col("at_least"))) & (F.col("at_most").isNull() | (F.col("value") <= F.col("at_most")))
    return thresholds.join(metrics, "metric", "left").select("metric", "value", F.coalesce(F.col("value").isNotNull() & inside, F.lit(False)).alias("passed"))


def label_metrics(samples: DataFrame, by: str) -> DataFrame:
    """Recall, precision and forbidden rate of label sets ``expected, forbidden, predicted``, and the manual-review rate; null without a base."""
    n = lambda c: F.sum(F.size(c))
    ok, bad = F.array_intersect("expected", "predicted"), F.array_intersect("forbidden", "predicted")
    return samples.groupBy(by).agg(
        F.round(F.try_divide(n(ok), n("expected")), 6).alias("recall"),
        F.round(F.try_divide(n(ok), n("predicted")), 6).alias("precision"),
        F.round(F.try_divide(n(bad), n("forbidden")), 6).alias("forbidden_rate"),
        F.round(F.avg(F.col("manual").cast("double")), 6).alias("manual_rate"),
    )


def manifest_checks(manifest: DataFrame, id_col: str, source_col: str, expected: int, allowed: list[str]) -> DataFrame:
    return manifest.agg(
        (F.count("*") == expected).alias("right_count"),
        (F.count("*") == F.count_distinct(id_col)).alias("unique_ids"),
        (F.count_if(~F.col(source_col).isin(allowed)) == 0).alias("allowed_sources"),
    )


def criterion_verdicts(criteria: DataFrame, group: str) -> DataFrame:
    """Verdict and confidence of each group from criteria with ``observable, evidence, met``: one failure fails, doubt is UNCERTAIN."""
    verdict = F.when(~F.col("observable"), "NOT_OBSERVABLE").when(F.col("evidence") == 0, "UNCERTAIN").when(F.col("met"), "PASS").otherwise("FAIL")
    rows = criteria.withColumn("verdict", verdict)
    v = F.col("verdict")
    return rows.groupBy(group).agg(
        F.when(F.bool_or(v == "FAIL"), "FAIL").when(F.bool_and(v == "PASS"), "PASS").when(F.bool_and(v == "NOT_OBSERVABLE"), "NOT_OBSERVABLE").otherwise("UNCERTAIN").alias("suggestion"),
        F.round(F.avg(v.isin("PASS", "FAIL").cast("double")), 6).alias("confidence"),
    )


