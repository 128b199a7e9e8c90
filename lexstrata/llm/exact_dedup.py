"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

Long texts move once at most: a fixed-width fingerprint of each text finds
the few texts that may have a copy, and only those are cut into
content-defined chunks.  Chunks are deduplicated to identifiers, the
identifiers are verified against the chunk contents, and two texts are equal
when their ordered identifier lists are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import cut_lineage, salted_join, weighted_join, written

#: A chunk has 256 characters at least, ends behind white space that follows
#: one of these letters, and has 2048 characters at most.
CHUNK_PATTERN = r"(?s).{256,2046}?[dnsty]\s|.{1,2048}"


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """Groups of rows whose whole texts are identical; the largest id stays.

    Returns one row for each input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``.  A null text counts as empty, and all empty texts are
    equal.  Rows that repeat an id and its text count as members of their
    group and share the decision.  A null id sorts below all others and is
    kept only in a group without any id.  Other columns are ignored, whatever
    their names.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    prints = rows.select(
        "doc_id",
        F.octet_length("_text").alias("_bytes"),
        F.xxhash64("_text").alias("_print"),
        F.sha2("_text", 256).alias("text_sha256"),
    )
    shared = prints.groupBy("_bytes", "_print").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    keyed = rows.withColumns({"_bytes": F.octet_length("_text"), "_print": F.xxhash64("_text")})
    # Written once: the chunks are read twice, the whole texts are not moved twice.
    candidates = written(salted_join(keyed, shared, ["_bytes", "_print"], F.col("doc_id"), "left_semi", salts), "exact-candidates")

    pieces = candidates.select(
        "doc_id", "_bytes", "_print", F.posexplode_outer(F.regexp_extract_all("_text", F.lit(CHUNK_PATTERN), F.lit(0))).alias("_pos", "_chunk")
    ).withColumn("_digest", F.unhex(F.sha2("_chunk", 256)))
    # Verified identifiers: a digest that stands for two contents is completed by the content itself.
    doubtful = (
        pieces.filter(F.col("_chunk").isNotNull())
        .groupBy("_digest", "_chunk")
        .agg(F.lit(1).alias("_one"))
        .groupBy("_digest")
        .agg(F.count("*").alias("_contents"))
        .filter("_contents > 1")
    )
    named = salted_join(pieces, doubtful, ["_digest"], F.struct("doc_id", "_pos"), "left", salts).withColumn(
        "_ident", F.when(F.col("_contents").isNull(), F.col("_digest")).otherwise(F.concat("_digest", F.encode("_chunk", "UTF-8")))
    )
    recipes = named.groupBy("doc_id", "_bytes", "_print").agg(
        F.array_sort(F.collect_set(F.struct(F.coalesce("_pos", F.lit(0)).alias("pos"), "_ident"))).alias("_parts"),
        F.count_if(F.coalesce("_pos", F.lit(0)) == 0).alias("_rows"),
    )
    recipes = recipes.select("doc_id", "_bytes", "_print", "_rows", F.transform("_parts", lambda p: p["_ident"]).alias("_recipe"))
    groups = recipes.groupBy("_bytes", "_print", "_recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("_rows").alias("group_size"))
    decided = salted_join(recipes, groups, ["_bytes", "_print", "_recipe"], F.col("doc_id"), "inner", salts).select(
        "doc_id", "_bytes", "_print", "keep_id", "group_size"
    )
    both = prints.alias("p").join(
        decided.alias("d"),
        F.col("p.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("p._bytes") == F.col("d._bytes")) & (F.col("p._print") == F.col("d._print")),
        "left",
    )
    keep = F.when(F.col("d.group_size").isNull(), F.col("p.doc_id")).otherwise(F.col("d.keep_id"))
    return both.select(
        F.col("p.doc_id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce(F.col("d.group_size"), F.lit(1)).cast("long").alias("group_size"),
        F.col("p.doc_id").eqNullSafe(keep).alias("kept"),
        F.col("p.text_sha256").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = exact_duplicates(docs, id_col, text_col)
    lost = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_lost"), F.col("text_sha256").alias("_sha")).distinct()
    sha = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    return docs.join(lost, docs[id_col].eqNullSafe(lost["_lost"]) & (sha == lost["_sha"]), "left_anti")


def drop_repeated_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of the rows that repeat an id with its text.

    Null ids are equal here, and null texts are empty.  Where the other
    columns differ, the row whose JSON is least stays.  Texts move only if
    there is such a row at all.
    """
    key = F.concat_ws("|", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), F.col(id_col).cast("string"))
    rows = docs.withColumn("_lexstrata_key", key)
    repeated = cut_lineage(rows.groupBy("_lexstrata_key").agg(F.count("*").alias("_lexstrata_n")).filter("_lexstrata_n > 1"))
    if repeated.isEmpty():
        return docs
    single, several = (weighted_join(rows, repeated, ["_lexstrata_key"], F.spark_partition_id(), how, "_lexstrata_n") for how in ("left_anti", "left_semi"))
    least = F.to_json(F.struct(*(c for c in docs.columns if c != text_col)))
    one = several.groupBy("_lexstrata_key").agg(F.min_by(F.struct(*docs.columns), least).alias("_lexstrata_row"))
    return single.select(*docs.columns).unionByName(one.select("_lexstrata_row.*"))
