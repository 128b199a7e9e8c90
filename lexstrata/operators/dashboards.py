"""Usage, latency and quality reports over message, trace and document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.functions.text import half_up


def within(ts: Column, start: str, end: str) -> Column:
    """Half-open range of two time literals."""
    return (ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp"))


def overview(events: DataFrame, start: str, end: str, before: str, ts: str = "ts", user: str = "user_id") -> DataFrame:
    """Totals, the window, the window before it, the change, and the change in per cent (null without a base)."""
    now, then = within(F.col(ts), start, end), within(F.col(ts), before, start)
    one = events.agg(
        F.count("*").alias("total"),
        F.count_if(now).alias("current"),
        F.count_if(then).alias("previous"),
        F.count_distinct(F.when(now, F.col(user))).alias("users"),
        F.count_distinct(F.when(then, F.col(user))).alias("users_before"),
    )
    pct = lambda a, b: F.when(F.col(b) > 0, half_up((F.col(a) - F.col(b)) * 100.0 / F.col(b)))
    return one.select("*", (F.col("current") - F.col("previous")).alias("delta"), pct("current", "previous").alias("delta_pct"), pct("users", "users_before").alias("users_pct"))


def performance(runs: DataFrame, slow_ms: int = 20_000) -> DataFrame:
    """One row over ``status, duration_ms, answered``: mean and nearest-rank p95 of successful durations above 0, and rates in per cent."""
    good = (F.col("status") == "SUCCESS") & (F.col("duration_ms") > 0)
    rate = lambda c: half_up(F.count_if(c) * 100.0 / F.count("*"))
    return runs.agg(
        F.round(F.avg(F.when(good, F.col("duration_ms")))).cast("long").alias("avg_ms"),
        F.expr("cast(percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN status = 'SUCCESS' AND duration_ms > 0 THEN duration_ms END) as bigint)").alias("p95_ms"),
        rate(F.col("status") == "SUCCESS").alias("success_rate"),
        rate(F.col("status") == "ERROR").alias("error_rate"),
        rate(~F.col("answered")).alias("no_answer_rate"),
        rate(good & (F.col("duration_ms") > slow_ms)).alias("slow_rate"),
    )


def active_users(events: DataFrame, start: str, end: str, exact: bool = True) -> DataFrame:
    inside = events.filter(within(F.col("ts"), start, end))
    return inside.agg((F.count_distinct if exact else F.approx_count_distinct)("user_id").alias("users"))


def calendar(spark, start: str, end: str, unit: str) -> DataFrame:
    """``bucket``: every day or hour from ``start`` to ``end``, both included."""
    step = "interval 1 day" if unit == "day" else "interval 1 hour"
    return spark.sql(f"SELECT explode(sequence(date_trunc('{unit}', timestamp '{start}'), date_trunc('{unit}', timestamp '{end}'), {step})) AS bucket")


def trend(events: DataFrame, start: str, end: str, unit: str, measures: dict[str, Column], ts: str = "ts") -> DataFrame:
    """Measures of each bucket, 0 where nothing happened."""
    days = calendar(events.sparkSession, start, end, unit)
    grouped = events.groupBy(F.date_trunc(unit, ts).alias("bucket")).agg(*[c.alias(n) for n, c in measures.items()])
    return days.join(grouped, "bucket", "left").na.fill(0, list(measures))


def quality_trend(runs: DataFrame, messages: DataFrame, start: str, end: str, unit: str = "day") -> DataFrame:
    """Error rate of runs and no-answer rate of messages in each bucket, in per cent."""
    r = trend(runs, start, end, unit, {"runs": F.count("*"), "errors": F.count_if(F.col("status") == "ERROR")})
    m = trend(messages, start, end, unit, {"messages": F.count("*"), "unanswered": F.count_if(~F.col("answered"))})
    rate = lambda a, b: F.when(F.col(b) > 0, half_up(F.col(a) * 100.0 / F.col(b))).otherwise(0.0)
    return r.join(m, "bucket").select("bucket", rate("errors", "runs").alias("error_rate"), rate("unanswered", "messages").alias("no_answer_rate"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("total"), F.count_if("enabled").alias("enabled"), F.count_if(F.col("enabled") & F.col("legal")).alias("legal"), F.count_if("removed").alias("removed"))


def documents_per_base(bases: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    n = docs.groupBy(key).agg(F.count("*").alias("documents"))
    return bases.join(n, key, "left").na.fill(0, ["documents"])


def stage_timing(tasks: DataFrame, total: str, stages: list[str]) -> DataFrame:
    """What of the total no stage accounts for, 0 at least."""
    spent = sum((F.coalesce(F.col(s), F.lit(0)) for s in stages), F.lit(0))
    return tasks.withColumn("other", F.greatest(F.lit(0), F.col(total) - spent))


def trace_details(runs: DataFrame, nodes: DataFrame, users: DataFrame, most: int | None = None) -> DataFrame:
    """Runs with the time to the first token of their user, the user's name and the question in their extra data, newest first."""
    first = nodes.filter("node_type = 'USER_TTFT'").groupBy("trace_id").agg(F.min_by("duration_ms", F.struct("start", "node_id")).alias("ttft_ms"))
    out = runs.join(first, "trace_id", "left").join(users, "user_id", "left").withColumn("question", F.get_json_object("extra_data", "$.k"))
    return out if most is None else out.orderBy(F.desc("start"), "trace_id").limit(most)


def node_type_share(nodes: DataFrame) -> DataFrame:
    """``trace_id, node_type, duration_ms, share`` of each trace's node time."""
    per = nodes.groupBy("trace_id", "node_type").agg(F.sum("duration_ms").alias("duration_ms"))
    total = F.sum("duration_ms").over(Window.partitionBy("trace_id"))
    return per.withColumn("share", F.round(F.col("duration_ms") / total, 6))


def edited(chunks: DataFrame, key: str, created: str, updated: str, grace: str = "interval 1 second") -> DataFrame:
    """Documents with a chunk that changed more than ``grace`` after it was made."""
    return chunks.filter(F.col(updated) > F.col(created) + F.expr(grace)).select(key).distinct()


def latency(runs: DataFrame, column: str, by: list[str]) -> DataFrame:
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")
    return runs.groupBy(*by).agg(F.round(F.avg(column), 4).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"))
