"""The chain behind retrieval: deduplicate, fuse, rerank, top up, gate, cite and assemble.

A ranked list has ``query_id, channel, rank, key, score`` and what its rows
carry; every step takes and returns such tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANNELS = ("vector", "keyword", "web", "hybrid")


def check_budget(recall: int, candidates: int, final: int) -> None:
    if not recall >= candidates >= final > 0:
        raise ValueError("recall >= candidates >= final > 0 is needed")


def chunk_key(id_: Column, text: Column) -> Column:
    """The id, or a hash of the text where the id is blank."""
    return F.when(F.length(F.trim(F.coalesce(id_, F.lit("")))) > 0, id_).otherwise(F.sha2(F.coalesce(text, F.lit("")), 256))


def channel_order(channel: Column) -> Column:
    return F.coalesce(*[F.when(channel == c, F.lit(i)) for i, c in enumerate(CHANNELS)], F.lit(len(CHANNELS)))


def deduplicated(hits: DataFrame) -> DataFrame:
    """The first row of each (query, key), by channel order, then rank."""
    first = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(channel_order(F.col("channel")), "rank"))
    return hits.withColumn("_r", first).filter("_r = 1").drop("_r")


def fused(hits: DataFrame, weights: dict[str, float], k: int = 20, limit: int = 20) -> DataFrame:
    """Weighted reciprocal-rank fusion: ``query_id, key, score, place``.

    The score is the sum of weight / (k + rank), as a float; ties keep the
    order of deduplication.  A query that one channel answered keeps its
    ranks.
    """
    w = F.coalesce(*[F.when(F.col("channel") == c, F.lit(float(x))) for c, x in weights.items()], F.lit(1.0))
    per = hits.groupBy("query_id", "key").agg(F.sum(w / (k + F.col("rank"))).cast("float").alias("score"), F.min(F.struct(channel_order(F.col("channel")).alias("c"), "rank")).alias("_f"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "_f", "key"))
    return per.withColumn("place", place).filter(F.col("place") <= limit).drop("_f")


def attribution(kept: DataFrame, hits: DataFrame) -> DataFrame:
    """Channels that found each kept row: ``query_id, key, channels``."""
    return kept.select("query_id", "key").join(hits, ["query_id", "key"]).groupBy("query_id", "key").agg(F.array_sort(F.collect_set("channel")).alias("channels"))


def attribution_counts(kept: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows of each channel before and after: ``channel, found, kept``."""
    before = hits.groupBy("channel").agg(F.count("*").alias("found"))
    after = attribution(kept, hits).select(F.explode("channels").alias("channel")).groupBy("channel").agg(F.count("*").alias("kept"))
    return before.join(after, "channel", "left").na.fill(0, ["kept"])


def reranked(rows: DataFrame, score: Column, final: int = 5) -> DataFrame:
    """The ``final`` best rows of each query by a rerank score; ties keep the place."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "place"))
    return rows.withColumn("rerank_score", score).withColumn("rank", order).filter(F.col("rank") <= final)


def coverage_top_up(selected: DataFrame, candidates: DataFrame, shared: str, final: int = 5, least: int = 2) -> DataFrame:
    """Candidates that share ``least`` anchor terms fill the free places, or replace the last one once.

    Both are ``query_id, key, rank``; candidates also have ``shared``.  A key
    counts once, whichever channels found it.
    """
    fit = candidates.filter(F.col(shared) >= least).groupBy("query_id", "key").agg(F.max(shared).alias(shared), F.min("rank").alias("rank"))
    extra = fit.join(selected.select("query_id", "key"), ["query_id", "key"], "left_anti")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(shared), "rank", "key"))
    sizes = selected.groupBy("query_id").agg(F.count("*").alias("_n"))
    ranked = extra.withColumn("_o", order).join(sizes, "query_id", "left").na.fill(0, ["_n"])
    free = F.lit(final) - F.col("_n")
    added = ranked.filter((F.col("_o") <= free) | ((free <= 0) & (F.col("_o") == 1)))
    added = added.select("query_id", "key", F.when(free <= 0, F.lit(final)).otherwise(F.col("_n") + F.col("_o")).cast("int").alias("rank"), (free <= 0).alias("_over"))
    over = added.filter("_over").select("query_id").distinct().withColumn("_cut", F.lit(True))
    kept = selected.select("query_id", "key", "rank").join(over, "query_id", "left").filter(F.col("_cut").isNull() | (F.col("rank") < final)).drop("_cut")
    return kept.unionByName(added.drop("_over"))


def evidence_gate(rows: DataFrame, score: str = "rerank_score", least: float = 0.2) -> DataFrame:
    """All rows of a query, or none if its best finite score is too low; a query without any score passes."""
    s = F.col(score)
    finite = F.when(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")), s)
    best = F.max(finite).over(Window.partitionBy("query_id"))
    return rows.withColumn("_best", best).filter(F.col("_best").isNull() | (F.col("_best") >= least)).drop("_best")


def enriched(rows: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Document id, index and name of each row; the name falls back to that of the document id that the row has."""
    c = chunks.select("key", F.col("doc_id").alias("_doc"), F.col("chunk_index").alias("_index"))
    d = documents.select(F.col("doc_id").alias("_d"), F.col("doc_name").alias("_name"))
    full = rows.join(c, "key", "left").withColumn("doc_id", F.coalesce("_doc", "doc_id"))
    return full.join(d, F.col("doc_id") == F.col("_d"), "left").withColumns({"chunk_index": F.col("_index"), "doc_name": F.coalesce("_name", "doc_name")}).drop("_doc", "_index", "_d", "_name")


def stage_trace(stages: dict[str, DataFrame], order: str = "rank") -> DataFrame:
    """``query_id, stage, keys``: the ordered distinct keys of every stage."""
    parts = [df.groupBy("query_id", F.lit(name).alias("stage"), "key").agg(F.min(order).alias("_o")) for name, df in stages.items()]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("query_id", "stage").agg(F.array_sort(F.collect_list(F.struct("_o", "key"))).alias("_k")).select("query_id", "stage", F.transform("_k", lambda x: x["key"]).alias("keys"))


def grouped_by_intent(rows: DataFrame, intents: DataFrame, other: str = "multi_channel") -> DataFrame:
    """``query_id, intent, keys``: rows under the intents of their collection, the rest under ``other``."""
    found = rows.join(intents.select("query_id", "collection", "intent"), ["query_id", "collection"], "left")
    return found.groupBy("query_id", F.coalesce("intent", F.lit(other)).alias("intent")).agg(F.array_sort(F.collect_set("key")).alias("keys"))


def eligible_intents(intents: DataFrame, rows: DataFrame) -> DataFrame:
    """Intents without those that were searched and gave nothing."""
    hit = rows.select("query_id", "collection").distinct()
    empty = intents.filter("directed").join(hit, ["query_id", "collection"], "left_anti").select("query_id", "intent")
    return intents.join(empty, ["query_id", "intent"], "left_anti")


def direct_evidence(pairs: DataFrame, question: str, evidence: str, anchors: list[str]) -> DataFrame:
    """Pairs that share an anchor, blanks in the evidence removed first; a question without any anchor has none."""
    bare = F.regexp_replace(F.col(evidence), r"\s+", "")
    both = reduce(lambda a, b: a | b, [F.contains(F.col(question), F.lit(x)) & F.contains(bare, F.lit(x)) for x in anchors])
    return pairs.filter(both)


def numbered_evidence(rows: DataFrame, order: list[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("number", n).withColumn("evidence_id", F.concat(F.lit("evidence-"), F.col("number")))


def best_per_document(rows: DataFrame, most: int | None = None, needs_text: bool = False) -> DataFrame:
    """The best row of each document of a query, numbered: ``query_id, doc_id, key, score, number``."""
    base = rows.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0) if needs_text else rows
    per = base.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.max_by("key", F.struct("score", -F.col("rank"))).alias("key"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    out = per.withColumn("number", n)
    return out if most is None else out.filter(F.col("number") <= most)


def assembled_context(rows: DataFrame, sources: DataFrame, most: int = 5) -> DataFrame:
    """One text for each query: rows by document in first-seen order, by chunk index inside, each document under its source number.

    Rows are ``query_id, rank, doc_id, chunk_index, text``; a row without a
    document stands alone.
    """
    group = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("rank")))
    named = rows.filter(F.col("rank") <= most).withColumn("_g", group).join(sources.select("query_id", "doc_id", "number"), ["query_id", "doc_id"], "left")
    docs = named.groupBy("query_id", "_g", "number").agg(F.min("rank").alias("_first"), F.array_sort(F.collect_list(F.struct(F.coalesce("chunk_index", F.lit(1 << 30)).alias("i"), "rank", "text"))).alias("_c"))
    head = F.concat(F.lit("["), F.coalesce(F.col("number").cast("string"), F.lit("-")), F.lit("] "))
    body = docs.select("query_id", "_first", F.concat(head, F.array_join(F.transform("_c", lambda c: c["text"]), "\n")).alias("_t"))
    return body.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_first", "_t"))).alias("_d")).select("query_id", F.array_join(F.transform("_d", lambda d: d["_t"]), "\n\n").alias("context"))


def merged_contexts(parts: DataFrame) -> DataFrame:
    """Contexts of sub-questions ``question, sub, context`` joined, with a running number over those that are not empty."""
    full = parts.filter(F.trim(F.coalesce("context", F.lit(""))) != "")
    n = F.row_number().over(Window.partitionBy("question").orderBy("sub"))
    numbered = full.withColumn("_n", n).select("question", "_n", F.concat(F.col("_n").cast("string"), F.lit(". "), F.col("context")).alias("_t"))
    return numbered.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("_n", "_t"))).alias("_p")).select("question", F.array_join(F.transform("_p", lambda p: p["_t"]), "\n").alias("context"))


def bounded_input(rows: DataFrame, group: str, order: list[str], text: str, most: int = 6000) -> DataFrame:
    """Numbered texts of a group within ``most`` characters in all; the last one is cut."""
    so_far = Window.partitionBy(group).orderBy(*order)
    before = F.coalesce(F.sum(F.length(text)).over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumns({"_before": before, "number": F.row_number().over(so_far)}).filter(F.col("_before") < most)
    return out.withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(most) - F.col("_before")).cast("int"))).drop("_before")


def fact_query(labelled: list[tuple[str, Column]], facts: Column, confidence: Column) -> tuple[Column, Column]:
    """A query text of labelled facts and distinct visible facts, and the confidence cut to 0..1."""
    parts = [F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(name + ": "), c)) for name, c in labelled]
    return F.concat_ws("; ", *parts, F.array_join(F.array_distinct(facts), ", ")), F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))
