"""Joins of positions with spans, by bins of the spans' own sizes.

A span of n positions belongs to the level of the least power of two that is
not below n, and touches at most two bins of that width; a position has one
bin on each level in use, of which there are at most 64.  A span fills at
least a quarter of the bins it touches, so what is compared stays in
proportion to what is found, however long a span is, and none is unrolled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A bin is hot with more positions than this, and more than one in a thousand of all.
HOT_ROWS, HOT_SHARE = 5000, 1000
SALTS = 16


def _level(n: Column) -> Column:
    """The exponent of the least power of two that is not below ``n``."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def _bin(at: str, level: str) -> Column:
    return F.expr(f"shiftright({at}, {level})")


def spans_of_points(
    points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str, salt_by: Column | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Each row of ``points`` with each row of ``spans`` of equal ``on`` where ``start <= at <= end``.

    Positions are whole numbers.  A null bound is open; spans that end before
    they start hold nothing, and neither do null positions or null keys.
    Repeated rows are kept on both sides.  ``salt_by`` deals the positions of
    hot bins over tasks; without it a hash of the row does.  Both sides may have
    further columns; names other than ``on`` must differ.
    """
    clash = (set(points.columns) & set(spans.columns)) - set(on)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    least, most = points.agg(F.min(at).cast("long"), F.max(at).cast("long")).first()
    if least is None:
        least, most = 0, -1
    # Open spans end where the positions do, and so do spans that reach beyond them.
    low = F.greatest(F.coalesce(F.col(start).cast("long"), F.lit(least)), F.lit(least))
    high = F.least(F.coalesce(F.col(end).cast("long"), F.lit(most)), F.lit(most))
    cut = spans.withColumns({"_low": low, "_high": high}).filter("_low <= _high").withColumn("_level", _level(F.col("_high") - F.col("_low") + 1))
    levels = sorted(r["_level"] for r in cut.select("_level").distinct().collect())
    bins = F.array_distinct(F.array(_bin("_low", "_level"), _bin("_high", "_level")))
    cut = cut.withColumn("_bin", F.explode(bins))
    keys = [*on, "_level", "_bin"]
    placed = points.filter(F.col(at).isNotNull()).withColumn("_at", F.col(at).cast("long"))
    placed = placed.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", _bin("_at", "_level"))
    counts = placed.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = points.count()
    # Fewer than HOT_SHARE bins of a level can be hot, so these are broadcast whatever the input.
    hot = counts.filter(F.col("_n") > max(hot_rows, total // HOT_SHARE)).select(*keys, F.lit(SALTS).alias("_salts"))
    plain = [f.name for f in points.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    salt = salt_by if salt_by is not None else F.xxhash64(*plain)
    a = placed.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(salt), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    b = cut.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    met = a.join(b, [*keys, "_salt"]).filter("_at between _low and _high")
    return met.select(*points.columns, *(c for c in spans.columns if c not in on))


def united(spans: DataFrame, on: list[str], start: str, end: str) -> DataFrame:
    """``on, start, end`` of the maximal runs that spans with both bounds cover together; runs that touch are one.

    Spans without a bound, or that end before they start, are passed over.
    """
    good = spans.filter(F.col(start) <= F.col(end)).groupBy(*on, start).agg(F.max(end).alias(end))
    order = Window.partitionBy(*on).orderBy(start)
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = good.withColumn("_new", (reached.isNull() | (F.col(start) > reached + 1)).cast("int"))
    runs = begun.withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy(*on, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")
