"""Rows that are alike in every column, taken apart or together without a hot task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import cut_lineage, weighted_join

#: Columns of a row's 128-bit print, and of the number of rows that it stands for.
PRINT, COPIES = ["_lexstrata_print_a", "_lexstrata_print_b"], "_lexstrata_copies"
#: Copies of one row that a task makes at a time.
BLOCK = 10_000


def printed(df: DataFrame, columns: list[str] | None = None, names: list[str] = PRINT) -> DataFrame:
    """``df`` with two seeded 64-bit hashes of its columns, or of some; null differs from every value by its own flag."""
    columns = [F.col(f"`{c}`") for c in columns or df.columns]
    nulls = F.concat(*(F.when(c.isNull(), F.lit("0")).otherwise(F.lit("1")) for c in columns))
    return df.withColumns({name: F.xxhash64(F.lit(seed), nulls, *columns) for seed, name in enumerate(names)})


def together(df: DataFrame) -> tuple[DataFrame, bool]:
    """One row for each set of equal rows, with its print and number of copies; and whether any set has two rows.

    Prints are counted first, with a partial count in each task; only if a
    print occurs twice do rows move at all, hot prints over many tasks.
    """
    rows = printed(df)
    repeated = cut_lineage(rows.groupBy(*PRINT).agg(F.count("*").alias("_times")).filter("_times > 1"))
    if repeated.isEmpty():
        return rows.withColumn(COPIES, F.lit(1).cast("long")), False
    single, several = (weighted_join(rows, repeated, PRINT, F.spark_partition_id(), how, "_times") for how in ("left_anti", "left_semi"))
    one = several.groupBy(*PRINT).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("_row"), F.count("*").alias(COPIES))
    return single.select(*df.columns, *PRINT).withColumn(COPIES, F.lit(1).cast("long")).unionByName(one.select("_row.*", *PRINT, COPIES)), True


def apart(df: DataFrame, repeated: bool, number: str = "_lexstrata_number") -> DataFrame:
    """``df`` with as many rows as ``together`` has counted, dealt in blocks; ``number`` names a column that counts them from 0."""
    if not repeated:
        return df.drop(COPIES).withColumn(number, F.lit(0).cast("long"))
    one = df.filter(F.col(COPIES) <= 1).withColumn(number, F.lit(0).cast("long"))
    more = df.filter(F.col(COPIES) > 1).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({COPIES} - 1) div {BLOCK}"))))
    more = more.repartition(*PRINT, "_block").withColumn(
        number, F.explode(F.sequence(F.col("_block") * BLOCK, F.least((F.col("_block") + 1) * BLOCK, F.col(COPIES)) - 1))
    )
    return one.unionByName(more.drop("_block")).drop(COPIES)
