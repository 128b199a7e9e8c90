"""Conversation windows, summaries, votes and memory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexstrata.operators import closure
from lexstrata.operators import conversations as conv
from lexstrata.plans.base import Family

family = Family()
QUERIES, ORACLES = family.QUERIES, family.ORACLES


@family.query(
    "cnv01_last_messages",
    "WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place FROM l WHERE b <= 3",
)
def _(t):
    return conv.last_messages(t("conversations"), 3).select("conv_id", "turn", "place")


HISTORY = """
    s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations WHERE role IN ('user', 'assistant') AND trim(text, ' ') <> ''),
    h AS (SELECT conv_id, turn, role, text FROM (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS f FROM s WHERE b <= 4) WHERE turn >= f)"""


@family.query("cnv02_prompt_history", f"WITH {HISTORY} SELECT * FROM h")
def _(t):
    return conv.prompt_history(t("conversations"), turns=2)


@family.query(
    "cnv03_question_answers",
    """
    WITH r AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations WHERE role IN ('user', 'assistant')),
    p AS (SELECT conv_id, asked, max(CASE WHEN role = 'user' THEN text END) AS question, arg_max(text, turn) FILTER (role = 'assistant' AND trim(text, ' ') <> '') AS answer FROM r WHERE asked IS NOT NULL GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY asked DESC) AS b FROM p WHERE answer IS NOT NULL)
    SELECT conv_id, asked, question, answer FROM n WHERE b <= 2""",
)
def _(t):
    return conv.question_answers(t("conversations"), 2)


@family.query(
    "cnv04_between",
    "SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant') AND turn > 0 AND (conv_id % 2 = 0 OR turn < 4)",
)
def _(t):
    bounds = t("conversations").select("conv_id").distinct().select("conv_id", F.lit(0).alias("after"), F.when(F.col("conv_id") % 2 != 0, 4).alias("before"))
    return conv.between(t("conversations"), bounds).select("conv_id", "turn", "role")


SUMMARIES = "m AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'system' OR (role = 'assistant' AND conv_id % 5 = 0))"


def summaries(t):
    return t("conversations").filter("role = 'system' or (role = 'assistant' and conv_id % 5 = 0)").select("conv_id", "turn", "text")


@family.query(
    "cnv04_between_summaries",
    f"""WITH {SUMMARIES}, d AS (SELECT DISTINCT conv_id, turn FROM m), b AS (SELECT conv_id, turn AS summary_turn, lead(turn, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM d)
    SELECT conv_id, summary_turn, turn, role FROM conversations JOIN b USING (conv_id) WHERE role IN ('user', 'assistant') AND turn > summary_turn AND (x IS NULL OR turn < x)""",
)
def _(t):
    """What each summary leaves to say up to the summary after the next, so that spans overlap."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    marks = summaries(t).select("conv_id", "turn").distinct()
    bounds = marks.select("conv_id", F.col("turn").alias("summary_turn"), F.col("turn").alias("after"), F.lead("turn", 2).over(order).alias("before"))
    return conv.between_each(t("conversations"), bounds).select("conv_id", "summary_turn", "turn", "role")


@family.query(
    "cnv05_summary_due",
    f"""WITH {SUMMARIES}, u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user'),
    c AS (SELECT conv_id, list_sort(list(turn)) AS l FROM u WHERE n >= 3 AND b <= 4 GROUP BY 1), d AS (SELECT conv_id, l[(len(l) - 1) // 2 + 1] AS cut_turn FROM c), k AS (SELECT conv_id, max(turn) AS x FROM m GROUP BY 1)
    SELECT conv_id, cut_turn FROM d LEFT JOIN k USING (conv_id) WHERE x IS NULL OR x < cut_turn""",
)
def _(t):
    return conv.summary_due(t("conversations"), summaries(t), start_at=3, window=4)


@family.query("cnv06_latest_summary", f"WITH {SUMMARIES} SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM m GROUP BY 1")
def _(t):
    return conv.latest_summary(summaries(t))


@family.query(
    "cnv07_conversation_list",
    "SELECT conv_id, substr(coalesce(arg_min(text, turn) FILTER (role = 'user'), ''), 1, 30) AS title, max(turn) AS last_turn, count(*) AS n_messages FROM conversations GROUP BY 1",
)
def _(t):
    return conv.conversation_list(t("conversations"))


@family.query(
    "cnv08_trim_candidates",
    """
    WITH c AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS cycle FROM conversations),
    o AS (SELECT *, role = 'assistant' AND max(cycle) OVER (PARTITION BY conv_id) - cycle >= 2 AS old FROM c),
    s AS (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY conv_id) AS BIGINT) AS context_chars, CAST(sum(CASE WHEN old THEN length(text) ELSE 0 END) OVER (PARTITION BY conv_id) AS BIGINT) AS reclaimable FROM o)
    SELECT conv_id, turn, cycle, context_chars, reclaimable FROM s WHERE old AND reclaimable >= 0.2 * context_chars""",
)
def _(t):
    return conv.trim_candidates(t("conversations"), F.col("role") == "assistant")


@family.query(
    "cnv09_compaction_cut",
    """
    WITH a AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS after, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations),
    k AS (SELECT conv_id, any_value(total) AS total, min(turn) AS cut_turn, max(after) AS kept FROM a WHERE role = 'user' AND after <= total * 0.4 GROUP BY 1)
    SELECT conv_id, cut_turn, CAST(total - kept AS BIGINT) AS material FROM k WHERE total - kept >= total * 0.5""",
)
def _(t):
    return conv.compaction_cut(t("conversations"), keep_share=0.4)


def feedback(t):
    """Votes by events: a purchase is for, an error against; the event's user and number give the message."""
    vote = F.when(F.col("event_type") == "purchase", 1).otherwise(-1)
    return t("events").filter("event_type in ('purchase', 'error')").select(F.col("user_id").alias("conv_id"), (F.col("event_id") % 8).alias("turn"), "event_id", vote.alias("vote"))


FEEDBACK = "f AS (SELECT user_id AS conv_id, event_id % 8 AS turn, event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS vote FROM events WHERE event_type IN ('purchase', 'error'))"


@family.query("cnv10_votes", f"WITH {FEEDBACK}, v AS (SELECT conv_id, turn, arg_min(vote, event_id) AS vote FROM f GROUP BY 1, 2) SELECT conv_id, turn, vote FROM conversations LEFT JOIN v USING (conv_id, turn)")
def _(t):
    return conv.votes(t("conversations"), feedback(t))


@family.query(
    "cnv11_source_feedback",
    f"""WITH {FEEDBACK}, a AS (SELECT DISTINCT conv_id, turn, unnest(['src' || (conv_id % 7), 'src' || (turn % 5)]) AS source FROM conversations WHERE role = 'assistant')
    SELECT source, count(*) AS votes, CAST(sum(vote) AS BIGINT) AS score FROM a JOIN f USING (conv_id, turn) GROUP BY 1""",
)
def _(t):
    cited = F.array(F.concat(F.lit("src"), F.col("conv_id") % 7), F.concat(F.lit("src"), F.col("turn") % 5))
    answers = t("conversations").filter("role = 'assistant'").select("conv_id", "turn", cited.alias("sources"))
    return conv.source_feedback(answers, feedback(t))


@family.query(
    "cnv12_supersede_chain",
    """SELECT user_id, event_type AS fact, event_id AS version, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS superseded_by, max(event_id) OVER (PARTITION BY user_id, event_type) AS latest,
        lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) IS NULL AND value < 200 AS valid FROM events""",
)
def _(t):
    facts = t("events").select("user_id", F.col("event_type").alias("fact"), F.col("event_id").alias("version"), F.when(F.col("value") < 200, "set").otherwise("retract").alias("action"))
    return conv.superseded_memory(facts).select("user_id", "fact", "version", "superseded_by", "latest", "valid")


@family.query(
    "cnv12_pointer_ends",
    """WITH p AS (SELECT event_id, max(event_id) OVER (PARTITION BY user_id, event_type) AS latest, count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) - 1 AS steps FROM events)
    SELECT event_id, latest, CAST(steps AS BIGINT) AS steps FROM p""",
)
def _(t):
    """What stands in place of each version, by following the pointers that the versions have."""
    order = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    pointers = t("events").select("event_id", F.lead("event_id").over(order).alias("superseded_by"))
    return closure.chain_ends(pointers, "event_id", "superseded_by").select(F.col("id").alias("event_id"), F.col("end").alias("latest"), "steps")



@family.query(
    "cnv13_valid_merges",
    """
    WITH g AS (SELECT o_orderkey AS group_id, o_orderpriority AS content, unnest([o_custkey, (o_custkey + o_orderkey % 3)]) AS memory_id FROM orders),
    d AS (SELECT DISTINCT * FROM g), u AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY group_id) AS u FROM d),
    j AS (SELECT u.*, c_mktsegment AS m, c_acctbal > 0 AS live FROM u LEFT JOIN customer ON c_custkey = memory_id)
    SELECT group_id, count(*) AS n, CAST(sum(length(m)) AS BIGINT) AS chars FROM j GROUP BY group_id, content
    HAVING count(*) >= 2 AND bool_and(coalesce(live, false)) AND bool_and(u = 1) AND length(content) <= 500 AND length(content) < sum(length(m))""",
)
def _(t):
    groups = t("orders").select(F.col("o_orderkey").alias("group_id"), F.array("o_custkey", F.col("o_custkey") + F.col("o_orderkey") % 3).alias("members"), F.col("o_orderpriority").alias("content"))
    memories = t("customer").select(F.col("c_custkey").alias("memory_id"), F.col("c_mktsegment").alias("content"), (F.col("c_acctbal") > 0).alias("live"))
    return conv.valid_merges(groups, memories)


@family.query(
    "cnv14_evictions",
    """
    WITH m AS (SELECT user_id, event_id AS memory_id, ts AS created, length(event_type) AS n, event_type = 'click' AS flush, event_id % 9 = 0 AS targeted FROM events),
    x AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total FROM m),
    r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY CASE WHEN flush THEN 1 ELSE 0 END, created, memory_id ROWS UNBOUNDED PRECEDING) AS gone FROM x WHERE NOT targeted)
    SELECT user_id, memory_id FROM r WHERE total - (gone - n) > 300 AND total - gone >= 0.75 * 300""",
)
def _(t):
    memories = t("events").select(
        "user_id", F.col("event_id").alias("memory_id"), F.col("ts").alias("created"), F.col("event_type").alias("content"),
        F.when(F.col("event_type") == "click", "FLUSH").otherwise("CHAT").alias("source_type"), (F.col("event_id") % 9 == 0).alias("targeted"),
    )
    return conv.evicted(memories, 300)


ATTEMPTS = "a AS (SELECT user_id AS conv_id, event_id % 6 AS to_turn, CASE event_type WHEN 'purchase' THEN 'DONE' WHEN 'click' THEN 'DROPPED' ELSE 'FAILED' END AS status FROM events)"


def attempts(t):
    status = F.when(F.col("event_type") == "purchase", "DONE").when(F.col("event_type") == "click", "DROPPED").otherwise("FAILED")
    return t("events").select(F.col("user_id").alias("conv_id"), (F.col("event_id") % 6).alias("to_turn"), status.alias("status"))


PENDING = "k AS (SELECT conv_id, max(to_turn) AS mark FROM a WHERE status IN ('DONE', 'DROPPED') GROUP BY 1), p AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place FROM conversations LEFT JOIN k USING (conv_id) WHERE role = 'user' AND (mark IS NULL OR turn > mark))"


@family.query("cnv15_pending_extraction", f"WITH {ATTEMPTS}, {PENDING} SELECT * FROM p WHERE place <= 2")
def _(t):
    return conv.pending_extraction(t("conversations"), attempts(t), 2)


@family.query(
    "cnv16_with_summary",
    f"""WITH {HISTORY}, {SUMMARIES}, l AS (SELECT conv_id, arg_max(text, turn) AS text FROM m GROUP BY 1)
    SELECT conv_id, turn, role, text FROM h UNION ALL SELECT conv_id, -1, 'system', text FROM l WHERE conv_id IN (SELECT conv_id FROM h)""",
)
def _(t):
    return conv.with_summary(conv.prompt_history(t("conversations"), turns=2), summaries(t))


@family.query(
    "cnv17_extraction_state",
    f"""WITH {ATTEMPTS}, {PENDING}, n AS (SELECT conv_id, count(*) AS pending FROM p GROUP BY 1), f AS (SELECT conv_id, count(*) AS attempts FROM a WHERE status = 'FAILED' GROUP BY 1),
    s AS (SELECT DISTINCT conv_id, coalesce(pending, 0) AS pending, coalesce(attempts, 0) AS attempts FROM conversations LEFT JOIN n USING (conv_id) LEFT JOIN f USING (conv_id))
    SELECT *, CASE WHEN pending = 0 THEN 'IDLE' WHEN attempts >= 3 THEN 'DROPPED' WHEN attempts > 0 THEN 'CONFLICT' WHEN pending < 3 THEN 'WAITING' ELSE 'READY' END AS state FROM s""",
)
def _(t):
    return conv.extraction_state(t("conversations"), attempts(t))
