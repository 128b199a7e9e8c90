"""Feedback in keyed state: the state store holds one value for each message and user."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType, TimestampType

from lexstrata.streaming.feedback import latest_feedback

KEYS = ["message_id", "user_id"]
#: What the state has of a pair, with the time in microseconds; a null vote is a cancellation.
VALUE = StructType([StructField("vote", IntegerType()), StructField("at", LongType()), StructField("event_id", LongType())])
PAIR = [StructField(k, LongType()) for k in KEYS]
CHANGE = StructType([*PAIR, StructField("vote", IntegerType()), StructField("submitted", TimestampType()), StructField("event_id", LongType())])
#: The state store that keyed state needs, with changes rather than whole snapshots at each batch.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class NewestVote(StatefulProcessor):
    """Keeps the newest event of a pair and passes on what changes it.

    Votes other than 1, -1 and null are dropped; ties go to the larger event
    id; an event that is as old as the state or older changes nothing, so
    repeats and late votes are safe.  A cancellation stays as a tombstone
    until the watermark has passed it, when no older vote can come any more;
    then a timer clears the pair.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", VALUE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.newest.get() if self.newest.exists() else None
        best = old = None if held is None else (held[1], held[2], held[0])
        for r in rows:
            if r["vote"] not in (None, 1, -1) or r["at"] is None:
                continue
            event = (r["at"], r["event_id"], r["vote"])
            if best is None or event[:2] > best[:2]:
                best = event
        if best is None or best == old:
            return
        self.newest.update((best[2], best[0], best[1]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if best[2] is None:
            self.handle.registerTimer(best[0] // 1000 + 1)
        yield Row(message_id=key[0], user_id=key[1], vote=best[2], at=best[0], event_id=best[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.newest.exists() and self.newest.get()[0] is None:
            self.newest.clear()
        return iter([])

    def close(self) -> None:
        pass


@contextmanager
def keyed_store(spark: SparkSession):
    """The settings of ``STORE`` for queries that start inside; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def changes(events: DataFrame, lateness: str) -> DataFrame:
    """The stream of changed pairs: ``message_id, user_id, vote, submitted, event_id``; later than ``lateness`` is too late."""
    time = F.col("submitted").cast("timestamp")
    rows = events.select(*KEYS, "vote", time.alias("submitted"), F.unix_micros(time).alias("at"), "event_id").withWatermark("submitted", lateness)
    found = rows.groupBy(*KEYS).transformWithState(NewestVote(), StructType([*PAIR, *VALUE.fields]), "Append", "eventTime")
    return found.select(*KEYS, "vote", F.timestamp_micros("at").alias("submitted"), "event_id")


def run_feedback(events: DataFrame, folder: str, lateness: str = "30 days") -> None:
    """Bring what has come in ``events`` into the log of changes below ``folder``, where the stream's progress is kept too.

    A batch costs what its keys cost: the state store writes the changed
    values, the file sink commits one batch's changes at a time.  A query that
    starts again goes on where the last has committed.
    """
    with keyed_store(events.sparkSession):
        stream = changes(events, lateness).writeStream.format("parquet").option("path", f"{folder}/log").option("checkpointLocation", f"{folder}/progress")
        stream.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def feedback_state(spark: SparkSession, folder: str) -> DataFrame:
    """The newest change of each pair, tombstones too."""
    try:
        return latest_feedback(spark.read.schema(CHANGE).parquet(f"{folder}/log"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CHANGE)
