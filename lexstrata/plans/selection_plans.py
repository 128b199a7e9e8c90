"""Row selection and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexstrata.operators import audit, selection
from lexstrata.plans.base import Family

family = Family()
QUERIES, ORACLES = family.QUERIES, family.ORACLES

TREE = """{"all": [{"field": "event_type", "operator": "in", "value": ["click", "error"]},
    {"any": [{"field": "value", "operator": "gt", "value": "120"}, {"field": "props", "operator": "contains", "value": "\\"k\\": 7"}]},
    {"not": {"field": "user_id", "operator": "lt", "value": 20}}, {"field": "missing", "operator": "not_exists"}]}"""


@family.query("sel01_audit_search", "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND user_id IN (1, 2, 3, 5, 8) AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'")
def _(t):
    found = selection.filtered(
        t("events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), equals={"event_type": "error", "value": None}, any_of={"user_id": [1, 2, 3, 5, 8]}, since={"day": "2024-01-05"}, until={"day": "2024-01-25"}
    )
    return found.select("event_id", "user_id")


@family.query(
    "sel02_due_work",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate <= TIMESTAMP '1998-01-01' AND (o_orderkey % 3 <> 0 OR o_orderdate + INTERVAL 30 DAY < TIMESTAMP '1998-01-01')",
)
def _(t):
    work = t("orders").select(
        "o_orderkey", (F.col("o_orderstatus") != "F").alias("enabled"), F.col("o_orderdate").alias("next_run"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate") + F.expr("interval 30 days")).alias("locked_until")
    )
    return selection.due(work, "1998-01-01 00:00:00").select("o_orderkey")


@family.query("sel03_keyword_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'rights') OR contains(lower(source), 'rights')")
def _(t):
    return selection.keyword_search(t("documents"), ["text", "source"], " Rights ").select("doc_id")


@family.query("sel04_sample", "SELECT doc_id, source FROM documents ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id LIMIT 15")
def _(t):
    return selection.repeatable_sample(t("documents"), "doc_id", 15).select("doc_id", "source")


@family.query("sel05_page", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(t):
    return selection.page(t("orders"), [F.desc("o_totalprice"), "o_orderkey"], 40, 20).select("o_orderkey", "o_totalprice", "total")


@family.query("sel06_first_seen", "SELECT l_suppkey, l_shipdate, min(l_orderkey) AS first_at FROM lineitem GROUP BY 1, 2")
def _(t):
    return selection.first_seen(t("lineitem"), "l_shipdate", "l_orderkey", ["l_suppkey"])


@family.query(
    "sel07_condition_tree",
    """SELECT event_id FROM events WHERE event_type IN ('click', 'error') AND (value > 120 OR contains(props, '"k": 7')) AND NOT user_id < 20""",
)
def _(t):
    df = t("events")
    return df.filter(selection.condition(TREE, df.columns)).select("event_id")


@family.query(
    "aud01_row_changes",
    """
    SELECT o_orderkey, '/o_orderstatus' AS pointer, o_orderstatus AS before, 'X' AS after FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 13 <> 0
    UNION ALL SELECT o_orderkey, '/o_custkey', CAST(o_custkey AS VARCHAR), CAST(o_custkey + 1 AS VARCHAR) FROM orders WHERE o_orderkey % 17 = 0 AND o_orderkey % 13 <> 0
    UNION ALL SELECT o_orderkey, unnest(['/o_orderstatus', '/o_custkey']), unnest([o_orderstatus, CAST(o_custkey AS VARCHAR)]), NULL FROM orders WHERE o_orderkey % 13 = 0""",
)
def _(t):
    k = F.col("o_orderkey")
    after = t("orders").filter(k % 13 != 0).withColumns({"o_orderstatus": F.when(k % 11 == 0, "X").otherwise(F.col("o_orderstatus")), "o_custkey": F.when(k % 17 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))})
    return audit.row_changes(t("orders"), after, "o_orderkey", ["o_orderstatus", "o_custkey"])


@family.query(
    "aud01_json_changes",
    """SELECT event_id, '/k' AS pointer, CAST(json_extract(props, '$.k') AS VARCHAR) AS before, CAST(CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS VARCHAR) AS after FROM events WHERE event_id % 4 = 0
    UNION ALL SELECT event_id, '/tags/1', NULL, '"new"' FROM events WHERE event_id % 4 = 0""",
)
def _(t):
    k = F.get_json_object("props", "$.k").cast("long")
    before = F.concat(F.lit('{"k": '), k, F.lit(', "tags": ["old"]}'))
    after = F.concat(F.lit('{"tags": ["old"'), F.when(F.col("event_id") % 4 == 0, ', "new"').otherwise(""), F.lit('], "k": '), F.when(F.col("event_id") % 4 == 0, k + 1).otherwise(k), F.lit("}"))
    return audit.json_changes(t("events").select("event_id", before.alias("before"), after.alias("after")), "event_id", "before", "after")


@family.query("aud02_newest_changes", "SELECT event_id, ts FROM events WHERE event_type = 'purchase' AND user_id = 7")
def _(t):
    return selection.filtered(t("events"), equals={"event_type": "purchase", "user_id": 7}).orderBy(F.desc("ts")).select("event_id", "ts")


@family.query("aud03_change_counts", "SELECT event_type, user_id, count(*) AS changes, count(*) FILTER (value < 100) AS succeeded FROM events GROUP BY 1, 2")
def _(t):
    return audit.change_counts(t("events"), ["event_type", "user_id"], F.col("value") < 100)
