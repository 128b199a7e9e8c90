"""Quotation linking for chat tables, in DataFrame operations only.

Lines that start with ``>`` marks are quotations; the number of marks is the
nesting level.  Quoted passages are normalised and hashed, joined to the
messages that first said them, and every message is placed in the thread of
the message it answers, without the quotations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.llm.common import cut_lineage, salted_join, weighted_join

#: The marks before a quoted line: ``>``, ``>>``, ``> >`` and so on.
MARKS = r"^[ \t]*(>[ \t>]*)"
#: White space behind the end of a sentence.
SENTENCE_GAP = r"(?<=[.!?。！？])\s+"
#: Turns of a run; a long conversation is numbered run by run.
RUN = 1024


def normalised(text: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def message_lines(messages: DataFrame, conv_col: str, turn_col: str, text_col: str) -> DataFrame:
    """One row per line: ``conv_id, turn, line, level, body``; level 0 is the author's own text."""
    lines = messages.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r\n|\r|\n")).alias("line", "_raw"),
    )
    marks = F.regexp_extract("_raw", MARKS, 1)
    return lines.select(
        "conv_id",
        "turn",
        "line",
        F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
        F.regexp_replace("_raw", MARKS, "").alias("body"),
    )


def own_text(text: Column) -> Column:
    """The text without its quoted lines, trimmed."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")
    return F.trim(F.array_join(F.filter(lines, lambda x: ~x.rlike(MARKS)), "\n"))


def _marked(messages: DataFrame, conv_col: str, turn_col: str, text_col: str) -> DataFrame:
    return messages.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).filter(F.col("text").rlike("(?m)" + MARKS))


def quoted_passages(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """The units that can be looked up: each quoted line, each unbroken block of one level, and each level of a message as one whole.

    Returns ``conv_id, turn, level, hash, size``; units without any letter or
    digit left after normalising are passed over.
    """
    marked = _marked(messages, conv_col, turn_col, text_col).distinct()
    lines = message_lines(marked.withColumn("turn", F.struct("turn", F.xxhash64("text").alias("print"))), "conv_id", "turn", "text").filter("level > 0")
    in_level = Window.partitionBy("conv_id", "turn", "level").orderBy("line")
    lines = lines.withColumn("block", F.col("line") - F.row_number().over(in_level))
    single = lines.select("conv_id", "turn", "level", normalised(F.col("body")).alias("_unit"))

    def joined(*by):
        whole = lines.groupBy("conv_id", "turn", "level", *by).agg(F.array_sort(F.collect_list(F.struct("line", "body"))).alias("_all"))
        return whole.select("conv_id", "turn", "level", normalised(F.array_join(F.transform("_all", lambda x: x["body"]), " ")).alias("_unit"))

    return (
        single.unionByName(joined("block"))
        .unionByName(joined())
        .filter(F.col("_unit").rlike(r"[\p{L}\p{N}]"))
        .select("conv_id", F.col("turn")["turn"].alias("turn"), "level", F.sha2("_unit", 256).alias("hash"), F.length("_unit").alias("size"))
        .distinct()
    )


def said_first(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """``conv_id, hash, said``: the first turn of a conversation that says a line, a sentence, a paragraph or a whole own text."""
    m = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), own_text(F.col(text_col)).alias("_own"))
    parts = [F.split("_own", r"\n"), F.split("_own", r"\n[ \t]*\n"), F.split("_own", SENTENCE_GAP), F.array("_own")]
    units = F.array_distinct(F.transform(F.concat(*parts), normalised))
    rows = m.select("conv_id", "turn", F.explode(units).alias("_unit")).filter(F.col("_unit").rlike(r"[\p{L}\p{N}]"))
    return rows.groupBy("conv_id", F.sha2("_unit", 256).alias("hash")).agg(F.min("turn").alias("said"))


def quotation_links(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, level, quoted_turn``: the earlier turn that a quote level cites.

    The turn that said most characters of the level wins, ties to the later
    turn.  A quotation that no earlier message of its conversation said has
    no link.
    """
    asked = quoted_passages(messages, conv_col, turn_col, text_col)
    # Only conversations that quote at all are indexed.
    quoting = asked.select(F.col("conv_id").alias("_conv")).distinct()
    named = messages.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("turn"), F.col(text_col).alias("text"))
    own = salted_join(named, quoting, ["_conv"], F.col("turn"), "left_semi")
    asked = cut_lineage(asked)
    # A passage that many turns quote is one key with all of them.
    times = asked.groupBy("conv_id", "hash").agg(F.count("*").alias("n"))
    said = said_first(own, "_conv", "turn", "text").join(times, ["conv_id", "hash"])
    hits = weighted_join(asked, said, ["conv_id", "hash"], F.col("turn"), "inner", "n").filter("said < turn")
    votes = hits.groupBy("conv_id", "turn", "level", "said").agg(F.sum("size").alias("_size"))
    return votes.groupBy("conv_id", "turn", "level").agg(F.max_by("said", F.struct("_size", "said")).alias("quoted_turn"))


def places(threads: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_order`` from distinct ``conv_id, thread_root, turn``: how many turns stand before by root and turn.

    Roots are counted in runs, then the turns of a root in runs, then the
    turns of one run, so no window holds a long conversation.  Keys that are
    null have no place.
    """
    runs = threads.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    runs = runs.withColumns({"_roots": F.floor(F.col("thread_root") / RUN), "_turns": F.floor(F.col("turn") / RUN)})
    before = lambda by, order: F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_roots, of_turns = ["conv_id", "_roots"], ["conv_id", "_roots", "thread_root", "_turns"]
    counts = runs.groupBy(*of_turns).agg(F.count("*").alias("_n"))
    inner = counts.select(*of_turns, before(of_roots, ["thread_root", "_turns"]).alias("_inner"))
    outer = counts.groupBy(*of_roots).agg(F.sum("_n").alias("_n")).select(*of_roots, before(["conv_id"], ["_roots"]).alias("_outer"))
    own = F.row_number().over(Window.partitionBy(*of_turns).orderBy("turn")) - 1
    placed = runs.withColumn("_own", own).join(inner, of_turns).join(outer, of_roots)
    return placed.select("conv_id", "turn", (F.col("_outer") + F.col("_inner") + F.col("_own")).cast("long").alias("reply_order"))


def reply_threads(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages without quotations, each with the message it answers and its thread.

    Returns one row for each input row: ``conv_id, turn, role, text`` (own
    text), ``n_quoted`` (quoted lines), ``quote_depth``, ``reply_to``,
    ``thread_root``, ``reply_depth`` and ``reply_order``.  ``reply_to`` is
    the earlier turn cited by the outermost resolved quote level, null
    without one; ``thread_root`` is the end of that chain, the turn itself
    without a reply.  ``reply_order`` is the place in the conversation read
    thread by thread: the number of turns that stand before by
    ``thread_root, turn``; rows of one turn share it.  Null text counts as
    empty; a message with a null turn or conversation is its own root and has
    no place; repeated rows are kept; other columns are ignored.
    """
    links = quotation_links(messages, conv_col, turn_col, text_col)
    parents = links.groupBy("conv_id", "turn").agg(F.min_by("quoted_turn", "level").alias("reply_to"))
    roots = cut_lineage(parents.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("_up"), F.lit(1).alias("_depth")))
    # Pointer doubling: each round doubles the length of the chains that are followed.
    while True:
        above = roots.select("conv_id", F.col("turn").alias("_up"), F.col("_up").alias("_next"), F.col("_depth").alias("_more"))
        # Many turns may answer one, so those who answer are dealt over copies of what they answer.
        moved = salted_join(roots, above, ["conv_id", "_up"], F.col("turn"), "left", salts=8)
        roots = cut_lineage(
            moved.select(
                "conv_id",
                "turn",
                "reply_to",
                F.coalesce("_next", "_up").alias("_up"),
                (F.col("_depth") + F.coalesce("_more", F.lit(0))).alias("_depth"),
                F.col("_next").isNotNull().alias("_moved"),
            )
        )
        if roots.filter("_moved").isEmpty():
            break
        roots = roots.drop("_moved")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r\n|\r|\n")
    levels = F.transform(lines, lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")))
    m = messages.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.col(role_col).alias("role"),
        own_text(F.col(text_col)).alias("text"),
        F.size(F.filter(levels, lambda n: n > 0)).alias("n_quoted"),
        F.array_max(levels).alias("quote_depth"),
    )
    replies = roots.select("conv_id", "turn", "reply_to", F.col("_up").alias("thread_root"), F.col("_depth").alias("reply_depth"))
    found = m.select("conv_id", "turn").distinct().join(replies, ["conv_id", "turn"], "left")
    found = cut_lineage(found.withColumn("thread_root", F.coalesce("thread_root", "turn")))
    found = found.join(places(found.select("conv_id", "thread_root", "turn")), ["conv_id", "turn"])
    # A row may be repeated any number of times; its copies are dealt by the task that reads them.
    return salted_join(m, found, ["conv_id", "turn"], F.struct("text", F.spark_partition_id()), "left", salts=8).select(
        "conv_id",
        "turn",
        "role",
        "text",
        "n_quoted",
        "quote_depth",
        "reply_to",
        F.coalesce("thread_root", "turn").alias("thread_root"),
        F.coalesce("reply_depth", F.lit(0)).alias("reply_depth"),
        "reply_order",
    )
