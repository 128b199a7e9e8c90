"""Corpus quality: reports, duplicates, coverage, numbering gaps and review signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.operators import intervals


def quality_report(elements: DataFrame, clauses: DataFrame, chunks: DataFrame, unstructured_share: float = 0.1, unknown_share: float = 0.05, most_tokens: int = 600) -> DataFrame:
    """Counts and a status for each document.

    FAILED without text, clauses or chunks, or with an empty chunk; REVIEW
    with oversized chunks, duplicate clauses, or too many unstructured lines
    or unknown roles; else PASS.  Each side is summed by document before the
    sides meet.
    """
    e = elements.groupBy("doc_id").agg(
        F.count("*").alias("n_elements"), F.sum(F.length("line")).alias("n_chars"), F.count_if(F.col("line_type") == "text").alias("n_unstructured")
    )
    same = clauses.groupBy("doc_id", "role", "clause_no", "text").agg(F.count("*").alias("n"), F.count_if(F.col("role").isNull() | (F.col("role") == "FRONT_MATTER")).alias("u"))
    c = same.groupBy("doc_id").agg(F.sum("n").alias("n_clauses"), F.sum(F.col("n") - 1).alias("n_duplicates"), F.sum("u").alias("n_unknown_role"))
    k = chunks.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.count_if(F.trim("content") == "").alias("n_empty"), F.count_if(F.col("tokens") > most_tokens).alias("n_oversized")
    )
    counts = ["n_elements", "n_chars", "n_unstructured", "n_clauses", "n_duplicates", "n_unknown_role", "n_chunks", "n_empty", "n_oversized"]
    all_ = e.join(c, "doc_id", "full").join(k, "doc_id", "full").na.fill(0, counts)
    failed = (F.col("n_chars") == 0) | (F.col("n_clauses") == 0) | (F.col("n_chunks") == 0) | (F.col("n_empty") > 0)
    review = (
        (F.col("n_oversized") > 0)
        | (F.col("n_duplicates") > 0)
        | (F.col("n_unstructured") > unstructured_share * F.col("n_elements"))
        | (F.col("n_unknown_role") > unknown_share * F.col("n_clauses"))
    )
    return all_.select("doc_id", *counts, F.when(failed, "FAILED").when(review, "REVIEW").otherwise("PASS").alias("status"))


def marked_duplicates(clauses: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Clauses with ``canonical_id`` of the first of their kind; only that one is eligible for the index."""
    first = F.first(order).over(Window.partitionBy(*keys).orderBy(order))
    return clauses.withColumn("canonical_id", first).withColumn("index_eligible", F.col("canonical_id") == F.col(order))


def duplicate_groups(clauses: DataFrame) -> DataFrame:
    """Repeated clause numbers of a document: EXACT with one text, NEAR with several, STRUCTURAL over two roles."""
    texts = clauses.groupBy("doc_id", "clause_no", "role", "text").agg(F.count("*").alias("n"))
    roles = texts.groupBy("doc_id", "clause_no", "role").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    per_role = roles.filter("n > 1").select("doc_id", "clause_no", "role", F.when(F.col("texts") == 1, "EXACT").otherwise("NEAR").alias("kind"), "n")
    across = roles.groupBy("doc_id", "clause_no").agg(F.count_if(F.col("role").isin("NORMATIVE", "COMMENTARY")).alias("r"), F.sum("n").alias("n"))
    structural = across.filter("r = 2").select("doc_id", "clause_no", F.lit("*").alias("role"), F.lit("STRUCTURAL").alias("kind"), "n")
    return per_role.unionByName(structural)


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``file_hash, n, first_id`` of texts that stand more than once."""
    return docs.groupBy(F.sha2(text_col, 256).alias("file_hash")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).filter("n > 1")


def unstructured_kind(line: Column) -> Column:
    """What a line without structure looks like."""
    t = F.trim(line)
    return (
        F.when(t.rlike(r"^(?:Figure|Table|图|表)\s*\d+"), "caption")
        .when(t.rlike(r"(?:\s{3,}\S+){2,}|\|"), "table_residue")
        .when(t.rlike(r"^[^\p{L}]*[=+/*^<>-][^\p{L}]*$"), "formula")
        .when(t.rlike(r"(?i)^(?:author|date|version|copyright|all rights reserved)\b"), "metadata")
        .when(t.rlike(r"(?i)^(?:appendix|附录)"), "appendix")
        .when((F.length(t) <= 40) & ~t.rlike(r"[.!?。！？;；,，]$"), "heading_like")
        .otherwise("normal")
    )


def coverage(lines: DataFrame, owned: Column) -> DataFrame:
    """Share of the non-blank characters of each document that lie in lines that something owns, and the uncovered runs."""
    order = Window.partitionBy("doc_id").orderBy("line_index")
    solid = F.length(F.regexp_replace("line", r"\s+", ""))
    rows = lines.withColumn("_n", solid).withColumn("_owned", owned).filter("_n > 0")
    start = ~F.col("_owned") & F.coalesce(F.lag("_owned").over(order), F.lit(True))
    return rows.withColumn("_start", start).groupBy("doc_id").agg(
        F.sum("_n").cast("long").alias("chars"),
        F.sum(F.when(F.col("_owned"), F.col("_n")).otherwise(0)).cast("long").alias("covered"),
        F.count_if("_start").alias("gaps"),
    ).withColumn("share", F.round(F.col("covered") / F.col("chars"), 6))


def coverage_by_spans(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """``coverage`` where the owners are spans ``doc_id, start, end`` of line indexes, which may overlap, nest and repeat.

    Returns ``doc_id, chars, covered, gaps, share``; a gap is a maximal run of
    non-blank lines that no span holds.
    """
    runs = intervals.united(spans.select("doc_id", "start", "end"), ["doc_id"], "start", "end")
    held = intervals.spans_of_points(lines.select("doc_id", "line_index"), runs, ["doc_id"], "line_index", "start", "end")
    marked = lines.join(held.select("doc_id", "line_index").distinct().withColumn("_held", F.lit(True)), ["doc_id", "line_index"], "left")
    return coverage(marked, F.col("_held").isNotNull())


def signature(rows: DataFrame, group: str, order: str, content: str) -> DataFrame:
    """A hash of the ordered content hashes of each group; equal for two runs that agree."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.sha2(content, 256).alias("h"))))
    return rows.groupBy(group).agg(parts.alias("_p")).select(group, F.sha2(F.array_join(F.transform("_p", lambda p: p["h"]), ","), 256).alias("signature"))


def sequence_gaps(rows: DataFrame, groups: list[str], number: str) -> DataFrame:
    """Numbers that jump by more than one within a group: ``groups, number, expected``."""
    before = F.lag(number).over(Window.partitionBy(*groups).orderBy(number))
    return rows.select(*groups, number).distinct().withColumn("_before", before).filter(F.col(number) > F.col("_before") + 1).select(
        *groups, F.col(number), (F.col("_before") + 1).alias("expected")
    )


def clause_gaps(clauses: DataFrame) -> DataFrame:
    """Decimal clause numbers of a chapter and section whose last part jumps by more than one after the same prefix."""
    parts = F.split("clause_no", r"\.")
    rows = clauses.select("doc_id", "clause_id", "chapter_no", "section_no", "clause_no", F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".").alias("prefix"), F.element_at(parts, -1).cast("long").alias("last"))
    order = Window.partitionBy("doc_id", "chapter_no", "section_no").orderBy("clause_id")
    rows = rows.withColumns({"_p": F.lag("prefix").over(order), "_l": F.lag("last").over(order)})
    return rows.filter((F.col("prefix") == F.col("_p")) & (F.col("last") > F.col("_l") + 1)).select(
        "doc_id", "clause_id", "clause_no", F.concat_ws(".", "prefix", (F.col("_l") + 1).cast("string")).alias("expected")
    )


def first_enumeration_gaps(items: DataFrame, group: list[str], order: str, marker: str) -> DataFrame:
    """The first item of each group whose marker is neither 1 nor one more than the marker before; a return to 1 opens a nested list."""
    before = F.lag(marker).over(Window.partitionBy(*group).orderBy(order))
    rows = items.withColumn("_before", F.coalesce(before, F.lit(0)))
    gaps = rows.filter((F.col(marker) != 1) & (F.col(marker) != F.col("_before") + 1))
    return gaps.groupBy(*group).agg(F.min_by(F.struct(F.col(order), F.col(marker), (F.col("_before") + 1).alias("expected")), order).alias("_gap")).select(
        *group, F.col("_gap")[order].alias(order), F.col("_gap")[marker].alias(marker), F.col("_gap")["expected"].alias("expected")
    )


def metadata_warnings(fields: dict[str, Column]) -> Column:
    """Names of the fields that are null or blank."""
    return F.array_compact(F.array(*[F.when(F.trim(F.coalesce(c.cast("string"), F.lit(""))) == "", F.lit("missing " + name)) for name, c in fields.items()]))


def upserted_signals(old: DataFrame, new: DataFrame) -> DataFrame:
    """Review signals after a new run: ``stable_key, fingerprint, lifecycle, review``.

    A signal that comes again keeps its review state if its fingerprint is
    the same, else it waits for review again; one that does not come again is
    STALE if it was pending, else it stays as it is.
    """
    o = old.select("stable_key", F.col("fingerprint").alias("_of"), F.col("review").alias("_review"))
    n = new.select("stable_key", F.col("fingerprint").alias("_nf"))
    both = o.join(n, "stable_key", "full")
    gone = F.col("_nf").isNull()
    return both.select(
        "stable_key",
        F.coalesce("_nf", "_of").alias("fingerprint"),
        F.when(gone & (F.col("_review") == "PENDING"), "STALE").otherwise("ACTIVE").alias("lifecycle"),
        F.when(gone, F.col("_review")).when(F.col("_nf") == F.col("_of"), F.col("_review")).otherwise("PENDING").alias("review"),
    )


def review_overview(signals: DataFrame, chunks_json: str = "related_chunk_ids") -> DataFrame:
    """Signals and distinct chunks by lifecycle and review state."""
    rows = signals.select("lifecycle", "review", "stable_key", F.explode_outer(F.from_json(chunks_json, "array<bigint>")).alias("chunk"))
    return rows.groupBy("lifecycle", "review").agg(F.count_distinct("stable_key").alias("signals"), F.count_distinct("chunk").alias("chunks"))


def chunk_review_status(chunks: DataFrame, signals: DataFrame) -> DataFrame:
    """The review state of each chunk from the states of its signals."""
    s = signals.groupBy("chunk_id").agg(
        F.bool_or(F.col("review") == "PENDING").alias("p"), F.bool_or(F.col("review") == "CONFIRMED").alias("c"), F.bool_or(F.col("lifecycle") == "STALE").alias("s"), F.count("*").alias("n_signals")
    )
    status = (
        F.when(F.col("n_signals").isNull(), "CLEAN")
        .when(F.col("p") & F.col("c"), "PARTLY_CONFIRMED")
        .when(F.col("p") & F.col("s"), "PENDING_STALE")
        .when(F.col("p"), "PENDING")
        .when(F.col("c"), "CONFIRMED")
        .when(F.col("s"), "STALE")
        .otherwise("DISMISSED")
    )
    return chunks.join(s, "chunk_id", "left").select("chunk_id", F.coalesce("n_signals", F.lit(0)).alias("n_signals"), status.alias("review_status"))


def stale_by_change(signals: DataFrame, changed: DataFrame) -> DataFrame:
    """Signals with ``lifecycle`` STALE where one of their chunks changed."""
    touched = signals.select("stable_key", F.explode("related").alias("chunk_id")).join(changed.select("chunk_id").distinct(), "chunk_id", "left_semi").select("stable_key").distinct()
    marked = signals.join(touched.withColumn("_hit", F.lit(True)), "stable_key", "left")
    return marked.withColumn("lifecycle", F.when(F.col("_hit"), "STALE").otherwise(F.col("lifecycle"))).drop("_hit")
