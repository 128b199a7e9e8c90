"""Shuffled shards by a two-pass external shuffle, in DataFrame operations only.

The first pass scatters records uniformly into buckets that fit in memory,
by a seeded hash of the record, or of columns that name it, and of its
number among its equals.  The second permutes each bucket by Fisher and
Yates and lays the buckets end to end; shards are equal runs of that order.
The result depends on the seed and the rows alone, not on how they are
partitioned, so a task that runs again gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.llm.common import shuffles_let_go, written
from lexstrata.llm.copies import COPIES, PRINT, apart, printed, together

#: A bucket has about so many rows, and bytes, at most.
BUCKET_ROWS, BUCKET_BYTES = 512, 8 << 20
#: Buckets, or runs of them, whose starts one task sums up.
FAN = 1024
#: A record's number among its equals; the columns that name a whole document.
NUMBER, SIZE, CHECKSUM = "_lexstrata_number", "_lexstrata_size", "_lexstrata_crc32"


def drawn(below: Column, *key) -> Column:
    """A number from 0 to ``below - 1``, from the first 32 bits of the key's SHA-256."""
    text = F.concat_ws(":", *(k if isinstance(k, Column) else F.lit(str(k)) for k in key))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long"), below)


def fisher_yates(n: Column, seed: int, bucket: Column) -> Column:
    """A permutation of 0 to ``n - 1`` as an array, inside out: element i goes to a drawn place j of 0 to i, what stood there moves to the end."""

    def step(order, i):
        j = drawn(i + 1, seed, bucket, i).cast("int")
        front, back = F.slice(order, F.lit(1), j), F.slice(order, j + 2, F.greatest(i - j - 1, F.lit(0)))
        return F.when(j == i, F.concat(order, F.array(i))).otherwise(F.concat(front, F.array(i), back, F.array(F.element_at(order, j + 1))))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<int>"), step)


def bucket_starts(counts: DataFrame, buckets: int) -> DataFrame:
    """``bucket, start``: the rows in all buckets before, summed up in runs of ``FAN``, and runs of runs."""
    rows = counts.select("bucket", "rows")
    if buckets <= FAN:
        before = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        return rows.select("bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    runs = rows.withColumn("run", F.expr(f"bucket div {FAN}"))
    totals = runs.groupBy("run").agg(F.sum("rows").alias("rows")).withColumnRenamed("run", "bucket")
    above = bucket_starts(totals, -(-buckets // FAN)).withColumnsRenamed({"bucket": "run", "start": "_base"})
    before = Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inner = runs.withColumn("_inner", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    return inner.join(above, "run").select("bucket", (F.col("_base") + F.col("_inner")).alias("start"))


def numbered(records: DataFrame, keys: list[str], repeated: bool) -> DataFrame:
    """``records`` with their number, from 0 on, among those with equal ``keys``; ``repeated`` tells whether any keys are equal."""
    if not repeated:
        return records.withColumn(NUMBER, F.lit(0).cast("long"))
    one, copies = together(records)
    if set(keys) == set(records.columns):
        return apart(one, copies, NUMBER)
    # Records that differ beside their keys stand one behind another, in parts, so that no key is one task's.
    names = ["_key_a", "_key_b"]
    kinds = printed(one, keys, names).select(*names, *PRINT, COPIES, F.pmod(PRINT[0], F.lit(FAN)).alias("_part"))
    sums = kinds.groupBy(*names, "_part").agg(F.sum(COPIES).alias("_n"))
    above = F.sum("_n").over(Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum(COPIES).over(Window.partitionBy(*names, "_part").orderBy(*PRINT).rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select(*names, "_part", F.coalesce(above, F.lit(0)).alias("_above"))
    offsets = kinds.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(bases, [*names, "_part"]).select(*PRINT, (F.col("_above") + F.col("_inside")).alias("_offset"))
    one = one.join(written(offsets.filter("_offset > 0"), "shard-offsets"), PRINT, "left")
    return apart(one, copies, NUMBER).withColumn(NUMBER, F.col(NUMBER) + F.coalesce("_offset", F.lit(0))).drop("_offset")


def shuffled_shards(records: DataFrame, shards: int, seed: int = 1, size_col: str | None = None, key_cols: list[str] | None = None) -> DataFrame:
    """``records`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard), in uniformly shuffled order.

    Counts of shards are at most one apart.  ``size_col`` names a column with
    the bytes of a record, by which buckets stay in memory.  ``key_cols``
    names columns by which places are drawn, all without it; the others move
    along.  Equal records are each dealt by themselves, so a record that is a
    third of all rows fills no bucket; nulls are values like others; no row
    is dropped.  An empty table gives an empty result.  Records must not hold
    maps.
    """
    keys = key_cols or records.columns
    slim = records.select(*dict.fromkeys([*(f"`{c}`" for c in keys), *([f"`{size_col}`"] if size_col else [])]))
    if key_cols:
        slim = written(slim, "shard-keys")  # the large columns are read once for all that follows, and once to be moved
    total = slim.agg(F.count("*").alias("n"), F.sum(F.col(size_col) if size_col else F.lit(0)).alias("b")).first()
    n, buckets = total["n"], max(1, -(-total["n"] // BUCKET_ROWS), -(-(total["b"] or 0) // BUCKET_BYTES))
    if buckets > 1 << 31:
        raise ValueError("more buckets than a draw of 32 bits can reach evenly")
    key = [F.col(f"`{c}`") for c in keys]
    place = drawn(F.lit(buckets), seed, *(F.coalesce(c.cast("string"), F.lit("")) for c in key), F.col(NUMBER)).alias("bucket")
    one, repeated = together(slim.select(*key))
    counts = apart(one, repeated, NUMBER).select(place).groupBy("bucket").agg(F.count("*").alias("rows"))
    starts = bucket_starts(counts, buckets)
    order = fisher_yates(F.col("rows").cast("int"), seed, F.col("bucket"))
    laid = counts.join(starts, "bucket").select("bucket", "start", order.alias("_order"))
    # Records are ranked first: what a task has fetched comes in any order.
    by = [F.col("record")[c] for c in (*keys, NUMBER)]
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*by)) - 1
    ranked = numbered(records, keys, repeated).select(place, F.struct(*(F.col(f"`{c}`") for c in records.columns), NUMBER).alias("record"))
    placed = ranked.withColumn("_rank", rank).join(laid, "bucket").withColumn("_place", F.col("start") + F.array_position("_order", F.col("_rank")) - 1)
    each, longer = n // shards, n % shards
    edge = longer * (each + 1)
    shard = F.when(F.col("_place") < edge, F.expr(f"_place div {each + 1}")).otherwise(F.expr(f"{longer} + (_place - {edge}) div {max(each, 1)}")).cast("int")
    first = shard * each + F.least(shard, F.lit(longer))
    return placed.select(*(F.col("record")[c].alias(c) for c in records.columns), shard.alias("shard"), (F.col("_place") - first).cast("long").alias("slot"))


def digest_columns(text_col: str, size: str = "size", checksum: str = "text_crc32") -> tuple[Column, Column]:
    """UTF-8 bytes of a text plus 8, and the unsigned checksum of these bytes; null text has none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (F.octet_length(text) + 8).cast("long").alias(size), F.crc32(text.cast("binary")).alias(checksum)


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, text_crc32`` of each row, and ``others`` of its columns."""
    return docs.select(F.col(id_col).alias("doc_id"), *digest_columns(text_col), *others)


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole records as Parquet, a folder ``shard=k`` for each shard; ``slot`` orders the rows of a shard.

    Places are drawn by id, size and checksum of the text.  Each task writes
    the buckets that it has permuted, so records move once.
    """
    named = docs.select("*", *(digest_columns(text_col, SIZE, CHECKSUM)))
    out = shuffled_shards(named, shards, seed, SIZE, [id_col, SIZE, CHECKSUM]).drop(SIZE, CHECKSUM)
    with shuffles_let_go(docs.sparkSession):
        out.write.partitionBy("shard").mode("errorifexists").parquet(path)


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """What ``write_shards`` has written of ``docs``."""
    schema = docs.limit(0).withColumns({"slot": F.lit(0).cast("long"), "shard": F.lit(0)}).schema
    return docs.sparkSession.read.schema(schema).parquet(path)
