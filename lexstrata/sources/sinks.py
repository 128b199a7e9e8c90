"""Sinks: replacement, upsert, keyword postings and deletes as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.functions.text import words


def replaced(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """The old artefacts of every document that ``new`` speaks of make way for the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_replaced(old_path: str, new: DataFrame, key: str = "doc_id", buckets: int = 64) -> None:
    """Replace documents in one plain table that is partitioned by a bucket of the key; only touched buckets are rewritten.

    Readers of the folder may see some buckets old and some new meanwhile;
    ``snapshots.Snapshots`` commits at once, over several tables too.
    """
    spark = new.sparkSession
    fresh = new.select("*", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"))
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old_path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        fresh.write.partitionBy("bucket").parquet(old_path)
        return
    kept = spark.read.parquet(old_path).join(fresh.select("bucket").distinct(), "bucket", "left_semi").select(fresh.columns)
    staged = f"{old_path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    replaced(kept, fresh, key).write.partitionBy("bucket").parquet(staged)
    spark.read.parquet(staged).select(fresh.columns).write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(old_path)
    files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged), True)


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key: the one with the highest version, new before old among equals."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), F.desc("_side")))
    return both.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_side")


def retrieval_text(body: Column, *titles: Column, most: int = 65535) -> Column:
    """Content, cut to what an index field takes, and titles, one under another."""
    return F.concat_ws("\n", F.substring(body, 1, most), *titles)


def postings(docs: DataFrame, id_col: str, fields: dict[str, Column]) -> DataFrame:
    """``term, field, doc_id, tf``: term counts of each field of each document."""
    parts = [docs.select(F.col(id_col).alias("doc_id"), F.lit(name).alias("field"), F.explode(words(c)).alias("term")) for name, c in fields.items()]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("term", "field", "doc_id").agg(F.count("*").alias("tf"))


def without_deleted(index: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """The same tombstones are applied to every index, so that they stay in step."""
    return index.join(tombstones.select(key).distinct(), key, "left_anti")


def index_batches(chunks: DataFrame, parts: int) -> DataFrame:
    """Eligible, enabled, live chunks, whole documents together and in order."""
    fit = chunks.filter("index_eligible and enabled and not deleted")
    return fit.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "chunk_index")
