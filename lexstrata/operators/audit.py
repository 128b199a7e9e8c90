"""Change logs: differences of snapshots, searches and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.sources.scratch import materialised


def row_changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, pointer, before, after``: one row for each column that differs; a missing row is all null."""
    b = before.select(F.col(key).alias("_bk"), *[F.col(c).cast("string").alias(f"_b_{c}") for c in columns])
    a = after.select(F.col(key).alias("_ak"), *[F.col(c).cast("string").alias(f"_a_{c}") for c in columns])
    both = b.join(a, F.col("_bk") == F.col("_ak"), "full").withColumn(key, F.coalesce("_bk", "_ak"))
    cells = F.array(*[F.struct(F.lit("/" + c).alias("pointer"), F.col(f"_b_{c}").alias("before"), F.col(f"_a_{c}").alias("after")) for c in columns])
    return both.select(key, F.explode(F.filter(cells, lambda x: ~x["before"].eqNullSafe(x["after"]))).alias("x")).select(key, "x.*")


def json_parts(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``key, pointer, value``: the parts of a JSON snapshot that are neither objects nor lists, by path, as JSON; null for null.

    One level is unfolded at a time, until no object or list is left, so any
    nesting is walked; a text that is no JSON has no parts, nor has an empty
    object or list.
    """
    parts = rows.select(key, F.lit("").alias("pointer"), F.try_parse_json(column).alias("v")).filter("v is not null")
    found = []
    while True:
        parts = materialised(parts.withColumn("_kind", F.schema_of_variant("v")), "json-level")
        inner = F.col("_kind").startswith("OBJECT") | F.col("_kind").startswith("ARRAY")
        found.append(parts.filter(~inner).select(key, "pointer", F.when(F.col("_kind") != "VOID", F.to_json("v")).alias("value")))
        if parts.filter(inner).isEmpty():
            return reduce(DataFrame.unionByName, found)
        step = F.coalesce(F.replace(F.replace(F.col("_c.key"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.col("_c.pos").cast("string"))
        unfolded = parts.filter(inner).lateralJoin(parts.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.struct("pos", "key", "value").alias("_c")))
        parts = unfolded.select(key, F.concat("pointer", F.lit("/"), step).alias("pointer"), F.col("_c.value").alias("v"))


def json_changes(rows: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """``key, pointer, before, after`` of two JSON snapshots, objects and arrays by path, missing parts as null.

    Keys are unique.  Rows whose snapshots are equal as texts are passed over.
    """
    changed = rows.filter(~F.col(before).eqNullSafe(F.col(after))).select(key, before, after)
    old = json_parts(changed, key, before).withColumnRenamed("value", "before")
    new = json_parts(changed, key, after).withColumnRenamed("value", "after")
    return old.join(new, [key, "pointer"], "full").filter(~F.col("before").eqNullSafe(F.col("after"))).select(key, "pointer", "before", "after")


def change_counts(log: DataFrame, by: list[str], success: Column) -> DataFrame:
    return log.groupBy(*by).agg(F.count("*").alias("changes"), F.count_if(success).alias("succeeded"))
