"""Work folders that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``; a local one only on a single machine without it."""
    key = "spark.checkpoint.dir"
    base = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{key} must name a folder that driver and executors share")
    base = base or os.path.join(tempfile.gettempdir(), "lexstrata-work")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, folder: str) -> None:
    """The folder goes, if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def dealt(df: DataFrame, *columns) -> DataFrame:
    """Dealt over all tasks by ``columns``, or evenly: not over fewer where the bytes are few but the work on a row is not."""
    context = df.sparkSession
    return df.repartition(max(context.sparkContext.defaultParallelism, int(context.conf.get("spark.sql.shuffle.partitions"))), *columns)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in such a folder, for results that one query reads several times."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
