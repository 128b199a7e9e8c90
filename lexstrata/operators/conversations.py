"""Windows over conversations, summaries, votes and long-term memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.functions.text import without_citations
from lexstrata.operators import intervals


def _conv():
    return Window.partitionBy("conv_id")


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each conversation with their place, oldest first."""
    back = F.row_number().over(_conv().orderBy(F.desc("turn")))
    kept = messages.withColumn("_b", back).filter(F.col("_b") <= n)
    return kept.withColumn("place", F.row_number().over(_conv().orderBy("turn"))).drop("_b")


def prompt_history(messages: DataFrame, turns: int = 8) -> DataFrame:
    """The last 2 x ``turns`` user and assistant messages with text, from the first user message on, answers without citations."""
    said = messages.filter(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    recent = last_messages(said, 2 * turns).withColumn("_first", F.min(F.when(F.col("role") == "user", F.col("place"))).over(_conv()))
    return recent.filter(F.col("place") >= F.col("_first")).select(
        "conv_id", "turn", "role", F.when(F.col("role") == "assistant", without_citations(F.col("text"))).otherwise(F.col("text")).alias("text")
    )


def question_answers(messages: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` pairs of each conversation: a user message and the newest answer before the next user message."""
    asked = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(_conv().orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    rows = messages.filter(F.col("role").isin("user", "assistant")).withColumn("asked", asked).filter(F.col("asked").isNotNull())
    pairs = rows.groupBy("conv_id", "asked").agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("question"),
        F.max_by("text", F.when((F.col("role") == "assistant") & (F.trim("text") != ""), F.col("turn"))).alias("answer"),
    )
    back = F.row_number().over(_conv().orderBy(F.desc("asked")))
    return pairs.filter(F.col("answer").isNotNull()).withColumn("_b", back).filter(F.col("_b") <= n).drop("_b")


def between(messages: DataFrame, bounds: DataFrame) -> DataFrame:
    """User and assistant messages strictly between two turns of ``conv_id, after, before``; a null bound is open."""
    rows = messages.join(bounds, "conv_id")
    inside = (F.col("after").isNull() | (F.col("turn") > F.col("after"))) & (F.col("before").isNull() | (F.col("turn") < F.col("before")))
    return rows.filter(inside & F.col("role").isin("user", "assistant")).drop("after", "before")


def between_each(messages: DataFrame, bounds: DataFrame) -> DataFrame:
    """``between`` for any number of bounds in a conversation, which may overlap: a row for each message and each bound that it lies in.

    ``bounds`` are ``conv_id, after, before`` and what tells one from another,
    which the result keeps.  Turns are whole numbers.
    """
    spans = bounds.withColumns({"_from": F.col("after") + 1, "_to": F.col("before") - 1}).drop("after", "before")
    said = messages.filter(F.col("role").isin("user", "assistant"))
    return intervals.spans_of_points(said, spans, ["conv_id"], "turn", "_from", "_to").drop("_from", "_to")


def summary_due(messages: DataFrame, summaries: DataFrame, start_at: int = 9, window: int = 8) -> DataFrame:
    """Conversations with enough user turns and the turn up to which to sum up: the middle of the last user turns.

    Those whose last summary covers that turn already are left out.
    """
    users = messages.filter("role = 'user'")
    back = F.row_number().over(_conv().orderBy(F.desc("turn")))
    total = F.count("*").over(_conv())
    recent = users.withColumns({"_b": back, "_n": total}).filter((F.col("_n") >= start_at) & (F.col("_b") <= window))
    cut = recent.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("_t"))
    due = cut.select("conv_id", F.element_at("_t", (F.floor((F.size("_t") - 1) / 2) + 1).cast("int")).alias("cut_turn"))
    covered = latest_summary(summaries).select("conv_id", F.col("turn").alias("_covered"))
    return due.join(covered, "conv_id", "left").filter(F.col("_covered").isNull() | (F.col("_covered") < F.col("cut_turn"))).drop("_covered")


def latest_summary(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def conversation_list(messages: DataFrame, title_chars: int = 30) -> DataFrame:
    """``conv_id, title, last_turn, n_messages``: the first question, cut, is the title."""
    return messages.groupBy("conv_id").agg(
        F.substring(F.coalesce(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))), F.lit("")), 1, title_chars).alias("title"),
        F.max("turn").alias("last_turn"),
        F.count("*").alias("n_messages"),
    )


def trim_candidates(messages: DataFrame, evictable: Column, keep_cycles: int = 2, least_share: float = 0.2) -> DataFrame:
    """Old evictable messages, where taking them out frees enough of the context.

    A cycle begins with each user message; the last ``keep_cycles`` stay.
    """
    so_far = _conv().orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = messages.withColumn("cycle", F.sum((F.col("role") == "user").cast("int")).over(so_far))
    old = evictable & (F.max("cycle").over(_conv()) - F.col("cycle") >= keep_cycles)
    rows = rows.withColumn("_old", old).withColumns({"context_chars": F.sum(F.length("text")).over(_conv()), "reclaimable": F.sum(F.when(F.col("_old"), F.length("text")).otherwise(0)).over(_conv())})
    return rows.filter(F.col("_old") & (F.col("reclaimable") >= least_share * F.col("context_chars"))).select("conv_id", "turn", "cycle", "context_chars", "reclaimable")


def compaction_cut(messages: DataFrame, keep_share: float = 0.2, least_material: float = 0.5) -> DataFrame:
    """``conv_id, cut_turn, material``: the first user message within the last share of the characters.

    Only where what stands before it makes up ``least_material`` of all.
    """
    after = F.coalesce(F.sum(F.length("text")).over(_conv().orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    rows = messages.withColumns({"_after": after, "_total": F.sum(F.length("text")).over(_conv())})
    keep = (F.col("role") == "user") & (F.col("_after") <= F.col("_total") * keep_share)
    cut = rows.groupBy("conv_id", "_total").agg(F.min(F.when(keep, F.col("turn"))).alias("cut_turn"), F.max(F.when(keep, F.col("_after"))).alias("_kept"))
    return cut.filter(F.col("cut_turn").isNotNull() & (F.col("_total") - F.col("_kept") >= F.col("_total") * least_material)).select("conv_id", "cut_turn", (F.col("_total") - F.col("_kept")).alias("material"))


def votes(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """The first vote on each message, null without one."""
    first = feedback.groupBy("conv_id", "turn").agg(F.min_by("vote", "event_id").alias("vote"))
    return messages.select("conv_id", "turn").join(first, ["conv_id", "turn"], "left")


def source_feedback(answers: DataFrame, feedback: DataFrame) -> DataFrame:
    """Votes summed by cited source: ``answers`` have ``conv_id, turn, sources array``."""
    cited = answers.select("conv_id", "turn", F.explode("sources").alias("source")).distinct()
    return cited.join(feedback, ["conv_id", "turn"]).groupBy("source").agg(F.count("*").alias("votes"), F.sum("vote").alias("score"))


def superseded_memory(facts: DataFrame) -> DataFrame:
    """Versions of facts ``user_id, fact, version, content, action``: the next version ends one, a retraction ends all.

    Returns each version with ``superseded_by``, ``valid`` and the latest
    version of its fact.
    """
    chain = Window.partitionBy("user_id", "fact").orderBy("version")
    whole = Window.partitionBy("user_id", "fact")
    rows = facts.withColumns({"superseded_by": F.lead("version").over(chain), "latest": F.max("version").over(whole)})
    return rows.withColumn("valid", F.col("superseded_by").isNull() & (F.col("action") != "retract"))


def valid_merges(groups: DataFrame, memories: DataFrame, most_chars: int = 500) -> DataFrame:
    """Proposals ``group_id, members array, content`` that may be carried out.

    Two distinct live members at least, none of them in an earlier group, and
    a text that is short enough and shorter than its members together.
    """
    members = groups.select("group_id", "content", F.explode(F.array_distinct("members")).alias("memory_id"))
    used = F.row_number().over(Window.partitionBy("memory_id").orderBy("group_id"))
    rows = members.withColumn("_u", used).join(memories.select("memory_id", F.col("content").alias("_m"), "live"), "memory_id", "left")
    per = rows.groupBy("group_id", "content").agg(
        F.count("*").alias("n"), F.bool_and(F.coalesce("live", F.lit(False))).alias("_live"), F.bool_and(F.col("_u") == 1).alias("_free"), F.sum(F.length("_m")).alias("chars")
    )
    fit = (F.col("n") >= 2) & F.col("_live") & F.col("_free") & (F.length("content") <= most_chars) & (F.length("content") < F.col("chars"))
    return per.filter(fit).select("group_id", "n", "chars")


def evicted(memories: DataFrame, limit: int, floor_share: float = 0.75) -> DataFrame:
    """Memories to take out of each user's block: oldest first, FLUSH-sourced last, until the block fits.

    Never below ``floor_share`` of the limit; targeted memories stay.
    """
    order = Window.partitionBy("user_id").orderBy(F.when(F.col("source_type") == "FLUSH", 1).otherwise(0), "created", "memory_id")
    total = F.sum(F.length("content")).over(Window.partitionBy("user_id"))
    rows = memories.withColumn("_total", total).filter(~F.col("targeted"))
    gone = F.sum(F.length("content")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_gone": gone, "_before": gone - F.length("content")})
    return rows.filter((F.col("_total") - F.col("_before") > limit) & (F.col("_total") - F.col("_gone") >= floor_share * limit)).select("user_id", "memory_id")


def pending_extraction(messages: DataFrame, runs: DataFrame, most: int = 40) -> DataFrame:
    """User messages behind the watermark of settled extraction runs, the first ``most`` of each conversation."""
    mark = runs.filter(F.col("status").isin("DONE", "DROPPED")).groupBy("conv_id").agg(F.max("to_turn").alias("_mark"))
    rows = messages.filter("role = 'user'").join(mark, "conv_id", "left").filter(F.col("_mark").isNull() | (F.col("turn") > F.col("_mark")))
    return rows.withColumn("place", F.row_number().over(_conv().orderBy("turn"))).filter(F.col("place") <= most).select("conv_id", "turn", "place")


def with_summary(history: DataFrame, summaries: DataFrame) -> DataFrame:
    """The latest summary of a conversation as the row before its history, where there is a history."""
    head = latest_summary(summaries).join(history.select("conv_id").distinct(), "conv_id", "left_semi")
    return head.select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), "text").unionByName(history.select("conv_id", "turn", "role", "text"))


def extraction_state(messages: DataFrame, runs: DataFrame, least_turns: int = 3, most_attempts: int = 3) -> DataFrame:
    """IDLE, WAITING, READY, CONFLICT or DROPPED for each conversation, by what is pending and how often it failed."""
    pending = pending_extraction(messages, runs, 1 << 30).groupBy("conv_id").agg(F.count("*").alias("pending"))
    failed = runs.filter("status = 'FAILED'").groupBy("conv_id").agg(F.count("*").alias("attempts"))
    rows = messages.select("conv_id").distinct().join(pending, "conv_id", "left").join(failed, "conv_id", "left").na.fill(0, ["pending", "attempts"])
    state = (
        F.when(F.col("pending") == 0, "IDLE")
        .when(F.col("attempts") >= most_attempts, "DROPPED")
        .when(F.col("attempts") > 0, "CONFLICT")
        .when(F.col("pending") < least_turns, "WAITING")
        .otherwise("READY")
    )
    return rows.withColumn("state", state)
