"""Dashboards over events as runs and messages; now is 2024-01-31."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexstrata.operators import dashboards, rollups
from lexstrata.plans.base import Family
from lexstrata.plans.retrieval_plans import TREE, tree
from lexstrata.operators import scope

family = Family()
QUERIES, ORACLES = family.QUERIES, family.ORACLES

START, END, BEFORE = "2024-01-24 00:00:00", "2024-01-31 00:00:00", "2024-01-17 00:00:00"
DAYS = "SELECT unnest(generate_series(TIMESTAMP '2024-01-24', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS bucket"


def runs(t):
    return t("events").select(
        F.col("event_id").alias("trace_id"), "ts", "user_id", F.when(F.col("event_type") == "error", "ERROR").otherwise("SUCCESS").alias("status"),
        F.floor(F.col("value") * 1000).cast("long").alias("duration_ms"), (F.col("event_type") != "view").alias("answered"), F.col("props").alias("extra_data"),
    )


RUNS = "r AS (SELECT event_id AS trace_id, ts, user_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'SUCCESS' END AS status, CAST(floor(value * 1000) AS BIGINT) AS duration_ms, event_type <> 'view' AS answered, props FROM events)"


@family.query(
    "agg01_overview",
    """
    WITH o AS (SELECT count(*) AS total, count(*) FILTER (ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31') AS current, count(*) FILTER (ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-24') AS previous,
        count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31') AS users, count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-24') AS users_before FROM events)
    SELECT *, current - previous AS delta, CASE WHEN previous > 0 THEN floor((current - previous) * 1000.0 / previous + 0.5) / 10 END AS delta_pct, CASE WHEN users_before > 0 THEN floor((users - users_before) * 1000.0 / users_before + 0.5) / 10 END AS users_pct FROM o""",
)
def _(t):
    return dashboards.overview(t("events"), START, END, BEFORE)


@family.query(
    "agg02_performance",
    f"""WITH {RUNS} SELECT CAST(round(avg(duration_ms) FILTER (status = 'SUCCESS' AND duration_ms > 0)) AS BIGINT) AS avg_ms, CAST(quantile_disc(duration_ms, 0.95) FILTER (status = 'SUCCESS' AND duration_ms > 0) AS BIGINT) AS p95_ms,
        floor(count(*) FILTER (status = 'SUCCESS') * 1000.0 / count(*) + 0.5) / 10 AS success_rate, floor(count(*) FILTER (status = 'ERROR') * 1000.0 / count(*) + 0.5) / 10 AS error_rate,
        floor(count(*) FILTER (NOT answered) * 1000.0 / count(*) + 0.5) / 10 AS no_answer_rate, floor(count(*) FILTER (status = 'SUCCESS' AND duration_ms > 20000) * 1000.0 / count(*) + 0.5) / 10 AS slow_rate FROM r""",
)
def _(t):
    return dashboards.performance(runs(t))


@family.query("agg03_active_users", "SELECT count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31'")
def _(t):
    return dashboards.active_users(t("events"), START, END)


@family.query(
    "agg04_daily_trend",
    f"""WITH d AS ({DAYS}), g AS (SELECT date_trunc('day', ts) AS bucket, count(*) AS messages, count(DISTINCT user_id) AS users FROM events GROUP BY 1)
    SELECT d.bucket, coalesce(messages, 0) AS messages, coalesce(users, 0) AS users FROM d LEFT JOIN g ON g.bucket = d.bucket""",
)
def _(t):
    return dashboards.trend(t("events"), START, END, "day", {"messages": F.count("*"), "users": F.count_distinct("user_id")})


@family.query(
    "agg05_hourly_trend",
    """WITH d AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-29', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS bucket), g AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS messages FROM events GROUP BY 1)
    SELECT d.bucket, coalesce(messages, 0) AS messages FROM d LEFT JOIN g ON g.bucket = d.bucket""",
)
def _(t):
    return dashboards.trend(t("events"), "2024-01-29 00:00:00", "2024-01-30 23:00:00", "hour", {"messages": F.count("*")})


@family.query(
    "agg07_quality_trend",
    f"""WITH {RUNS}, d AS ({DAYS}), g AS (SELECT date_trunc('day', ts) AS bucket, count(*) AS n, count(*) FILTER (status = 'ERROR') AS e, count(*) FILTER (NOT answered) AS u FROM r GROUP BY 1)
    SELECT d.bucket, CASE WHEN n > 0 THEN floor(e * 1000.0 / n + 0.5) / 10 ELSE 0.0 END AS error_rate, CASE WHEN n > 0 THEN floor(u * 1000.0 / n + 0.5) / 10 ELSE 0.0 END AS no_answer_rate FROM d LEFT JOIN g ON g.bucket = d.bucket""",
)
def _(t):
    return dashboards.quality_trend(runs(t), runs(t), START, END)


@family.query(
    "agg08_corpus_stats",
    """SELECT count(*) AS total, count(*) FILTER (coalesce(quality, 1) = 1) AS enabled, count(*) FILTER (coalesce(quality, 1) = 1 AND lang = 'de') AS legal, count(*) FILTER (coalesce(toxic, 0) = 1) AS removed FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(t):
    rows = t("documents").join(t("labels"), "doc_id", "left")
    return dashboards.corpus_stats(rows.select((F.coalesce("quality", F.lit(1)) == 1).alias("enabled"), (F.col("lang") == "de").alias("legal"), (F.coalesce("toxic", F.lit(0)) == 1).alias("removed")))


@family.query("agg09_documents_per_base", "WITH b AS (SELECT DISTINCT source FROM documents) SELECT b.source, count(d.doc_id) AS documents FROM b LEFT JOIN documents d ON d.source = b.source AND d.lang = 'fr' GROUP BY 1")
def _(t):
    return dashboards.documents_per_base(t("documents").select("source").distinct(), t("documents").filter("lang = 'fr'"), "source")


@family.query("agg10_block_kinds")
def _(t):
    from lexstrata.sources import parsers

    return parsers.document_blocks(t("documents")).groupBy("kind").agg(F.count("*").alias("n"))


@family.query(
    "agg11_stage_timing",
    """SELECT o_orderkey, CAST(max(datediff('day', o_orderdate, l_shipdate)) AS INTEGER) AS total, CAST(any_value(o_orderkey % 50) AS INTEGER) AS parse, CAST(any_value(o_custkey % 30) AS INTEGER) AS chunk,
        CAST(greatest(0, max(datediff('day', o_orderdate, l_shipdate)) - any_value(o_orderkey % 50) - any_value(o_custkey % 30)) AS INTEGER) AS other FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(t):
    days = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_custkey").agg(F.max(F.datediff("l_shipdate", "o_orderdate")).alias("total"))
    tasks = days.select("o_orderkey", "total", (F.col("o_orderkey") % 50).cast("int").alias("parse"), (F.col("o_custkey") % 30).cast("int").alias("chunk"))
    return dashboards.stage_timing(tasks, "total", ["parse", "chunk"])


def _nodes(t):
    kind = F.when(F.col("trace_id") % 2 == 0, "USER_TTFT").otherwise("RETRIEVE")
    return runs(t).select((F.col("trace_id") % 500).alias("trace_id"), F.col("trace_id").alias("node_id"), F.col("ts").alias("start"), kind.alias("node_type"), "duration_ms")


@family.query(
    "agg12_trace_details",
    f"""WITH {RUNS}, f AS (SELECT trace_id % 500 AS trace_id, arg_min(duration_ms, (ts, trace_id)) AS ttft_ms FROM r WHERE trace_id % 2 = 0 GROUP BY 1)
    SELECT r.trace_id, user_id, c_name, json_extract_string(props, '$.k') AS question, ttft_ms FROM r LEFT JOIN f ON f.trace_id = r.trace_id LEFT JOIN customer ON c_custkey = user_id""",
)
def _(t):
    users = t("customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    found = dashboards.trace_details(runs(t).withColumnRenamed("ts", "start"), _nodes(t), users)
    return found.select("trace_id", "user_id", "c_name", "question", "ttft_ms")


@family.query(
    "agg13_trace_tree",
    f"""WITH RECURSIVE {TREE}, {RUNS}, n AS (SELECT trace_id % 500 AS trace_id, CASE WHEN trace_id % 2 = 0 THEN 'USER_TTFT' ELSE 'RETRIEVE' END AS node_type, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM r GROUP BY 1, 2)
    SELECT 'share' AS part, CAST(trace_id AS VARCHAR) AS id, node_type AS name, round(duration_ms / sum(duration_ms) OVER (PARTITION BY trace_id), 6) AS value FROM n
    UNION ALL SELECT 'depth', id, path[-1], CAST(depth AS DOUBLE) FROM w""",
)
def _(t):
    share = dashboards.node_type_share(_nodes(t)).select(F.lit("share").alias("part"), F.col("trace_id").cast("string").alias("id"), F.col("node_type").alias("name"), F.col("share").alias("value"))
    return share.unionByName(scope.tree_paths(tree(t)).select(F.lit("depth").alias("part"), "id", F.element_at("path", -1).alias("name"), F.col("depth").cast("double").alias("value")))


@family.query("agg14_edited_documents", "SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 1 SECOND")
def _(t):
    rows = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return dashboards.edited(rows, "o_custkey", "o_orderdate", "l_shipdate")


@family.query("agg15_latency", "SELECT event_type, round(avg(value), 4) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def _(t):
    return dashboards.latency(t("events"), "value", ["event_type"])


@family.query(
    "agg15_rolling_sketches",
    """
    WITH w AS (SELECT date_trunc('day', ts) + i * INTERVAL 1 DAY AS window_end, days, event_type, user_id FROM events, (VALUES (1), (7)) AS s(days), (SELECT unnest(range(1, 8)) AS i) WHERE i <= days)
    SELECT window_end, CAST(days AS INTEGER) AS days, event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_close, true AS p95_close FROM w GROUP BY 1, 2, 3""",
)
def _(t):
    """Sketches of 24 hours and 7 days beside exact counts: users within three standard errors, the estimated p95 within 3 % of its rank."""
    by = ["event_type"]
    events = t("events").select("ts", "user_id", "event_type", "value")
    guessed = rollups.estimates(rollups.rolled(rollups.hourly(events, by), by, [1, 7]), {"p95": 0.95}).withColumnRenamed("users", "guess").drop("n")
    each = events.withColumn("days", F.explode(F.array(F.lit(1), F.lit(7)))).withColumn("_day", F.explode(F.sequence(F.lit(1), F.col("days"))))
    each = each.withColumn("window_end", F.date_trunc("day", "ts") + F.make_dt_interval(F.col("_day")))
    keys = ["window_end", "days", *by]
    below = (F.count_if(F.col("value") < F.col("p95")) / F.count("value"), F.count_if(F.col("value") <= F.col("p95")) / F.count("value"))
    exact = each.join(guessed, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.max("guess").alias("guess"), below[0].alias("lo"), below[1].alias("hi"))
    error = 3 * 1.04 / 2 ** (rollups.USER_BITS / 2)
    close = F.abs(F.col("guess") - F.col("users")) <= F.greatest(F.lit(1.0), error * F.col("users"))
    return exact.select(*keys, "n", "users", close.alias("users_close"), ((F.col("lo") <= 0.98) & (F.col("hi") >= 0.92)).alias("p95_close"))
