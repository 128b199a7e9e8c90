"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Spark's own setting to delete shuffle files at the end of an action.
TIDY_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's own setting for the size of the batches that go to Python workers, and what texts are dealt in.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only on a single machine without such a setting a local folder is chosen;
    a cluster without it is an error.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if not path:
        path = spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
    return path or os.path.join(tempfile.gettempdir(), "lexstrata-checkpoints")


@contextmanager
def shuffles_let_go(spark: SparkSession):
    """What runs inside is kept in shared storage, so its shuffle files go as soon as it has ended."""
    before = spark.conf.get(TIDY_KEY, "false")
    spark.conf.set(TIDY_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY_KEY, before)


def in_small_batches(spark: SparkSession) -> None:
    """Batches to Python workers hold ``BATCH_BYTES`` and one row at most, however long the texts are.

    By default 10,000 rows or 64 MB go at once, and the executor and its
    worker each hold that more than once for every core.  The setting stays:
    a result that is returned is computed by the caller.
    """
    spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    with shuffles_let_go(df.sparkSession):
        return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Unlike ``cut_lineage`` the result can be read by column.  The folder
    belongs to the caller's cluster storage and goes with its clean-up, or
    sooner by ``forget``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with shuffles_let_go(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexstrata_path = path
    return out


def forget(table: DataFrame) -> None:
    """Delete a table that ``written`` made and that no result still to be computed reads."""
    jvm, context = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(table._lexstrata_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def trimmed(work: Callable) -> Callable:
    """An Arrow function whose worker gives the memory that it has freed back to the machine when a task ends.

    Workers serve one task after another, and what the allocators keep would
    add up over the stages of a job.
    """

    def run(batches):
        try:
            yield from work(batches)
        finally:
            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def in_few_tasks(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``df`` in about one task for each 50,000 of ``rows``, where that is fewer: every task of a shuffle leaves files, however little it has."""
    return df.coalesce(max(1, -(-rows // each)))


def packed(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with the UTF-8 bytes of a text column compressed, which takes less room in a shuffle; null counts as empty."""
    schema = StructType([StructField(f.name, BinaryType()) if f.name == column else f for f in docs.schema.fields])

    def squeezed(batches):
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            at = batch.schema.get_field_index(column)
            small = pa.array([squeeze((x.as_py() or "").encode("utf-8", "surrogatepass")) for x in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([small if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(trimmed(squeezed), schema)


def unpacked(column) -> Iterator[bytes]:
    """The bytes of each compressed text of an Arrow column."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    return (expand(x.as_py()) for x in column)


def dealt_arrays(part: np.ndarray, *columns: np.ndarray):
    """An Arrow batch with one row for each part: ``part`` and an array ``c0, c1, ...`` of each column."""
    import pyarrow as pa

    order = np.argsort(part, kind="stable")
    part = part[order]
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    offsets = pa.array(np.append(edges, len(part)), pa.int32())
    arrays = [pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(part[edges], pa.int32()), *arrays], names=["part", *(f"c{i}" for i in range(len(columns)))])


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salt_by: Column, how: str, salts: int = 16) -> DataFrame:
    """Join a side with hot keys to a side with one row for each key.

    Each row of ``right`` is repeated ``salts`` times and each row of
    ``left`` goes to one of the copies, so that a key holding a third of all
    rows is dealt over ``salts`` tasks.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    a = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, "_salt"], how).drop("_salt")


def weighted_join(
    left: DataFrame, right: DataFrame, on: list[str], salt_by: Column, how: str, weight: str, least: int = 2000, most_hot: int = 1000, salts: int = 32, weights: DataFrame | None = None
) -> DataFrame:
    """``salted_join`` where ``right`` knows how many rows of ``left`` each of its keys has.

    Only keys with more than ``least`` rows, and more than one in ``most_hot``
    of all, are salted.  There are fewer than ``most_hot`` of these, whatever
    the input, so they are broadcast to ``left``; no other row of ``right`` is
    repeated.  ``weight`` is not part of the result.  ``weights``, a table
    with the keys and their weights, spares ``right`` from being written.
    """
    if weights is None:
        weights = right = cut_lineage(right)
    total = weights.agg(F.sum(weight).alias("n")).first()["n"] or 0
    hot = F.col(weight) > max(least, total // most_hot)
    marked = left.join(F.broadcast(weights.filter(hot).select(*on).withColumn("_hot", F.lit(1))), on, "left")
    a = marked.withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    each = F.sequence(F.lit(0), F.lit(salts - 1))
    b = right.withColumn("_salt", F.explode(F.when(hot, each).otherwise(F.array(F.lit(0))))).drop(weight)
    return a.join(b, [*on, "_salt"], how).drop("_salt")
