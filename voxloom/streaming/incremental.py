"""Incremental work (I01-I05) and, as an extension, event streams.

A batch job resumes by fingerprints (see operators.state); a stream does the same for files as they arrive. Which keys
its target has is kept as state by key, read from the target once, when a query first starts; a micro-batch costs what it
brings, however large the target is. A batch writes a folder of its own, so a batch that runs twice changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..shipping import ship


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder, as they arrive."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; rows that are more than ``late`` behind don't count. Works on batches too."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length).alias("window"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events with at most ``gap`` between one and the next."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the file system has ``path``; errors in asking for it rise."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _first_of_key(columns: list[str], order: list[str], event_time: str | None, horizon_ms: int) -> StatefulProcessor:
    """Hands on the first row of a key that has none yet; with an event time, forgets keys that time has passed.

    The class is made here, so that it travels by value: the process that prepares the state on the driver does not see
    the packages that are sent to executors.
    """

    class FirstOfKey(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.seen = handle.getValueState("seen", "seen boolean")

        def keep(self, at_ms: int | None) -> None:
            self.seen.update((True,))
            if event_time and at_ms is not None:
                self.handle.registerTimer(max(1, at_ms + horizon_ms))

        def handleInitialState(self, key, initialState, timerValues) -> None:
            self.keep(initialState["_at"])

        def handleInputRows(self, key, rows, timerValues):
            best = min(rows, key=lambda r: [(r[c] is not None, r[c]) for c in [*order, "_at"]])  # nulls first, as Spark has it
            if not self.seen.exists():
                self.keep(best["_at"])
                yield Row(**{c: best[c] for c in columns})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.seen.clear()
            return iter(())

        def close(self) -> None:
            pass

    return FirstOfKey()


def read_target(spark: SparkSession, target: str, schema) -> DataFrame:
    """What a table and the batches appended to it hold; empty if nothing is there. Errors in looking for it rise."""
    if not exists(spark, target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(target)


def append_new(stream: DataFrame, target: str, checkpoint: str, on: Sequence[str], order: Sequence[str] = (), event_time: str | None = None, horizon: str = "7 days") -> StreamingQuery:
    """Append to the Parquet table at ``target`` the rows of a stream whose keys it lacks, for all there is now.

    Of rows of one key in one micro-batch the first by ``order`` is kept, then any. Keys are state: those of the target
    are read once, when a query starts without a ``checkpoint``; a restart goes on from it. Without ``event_time`` keys
    are kept for ever, and a later row of a key never counts. With it, ``horizon`` is how late rows may come: later ones
    are dropped, and a key is forgotten once the watermark is so far beyond its row, which bounds the state. Read the table
    with ``read_target``.
    """
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.withWatermark(event_time, horizon) if event_time else stream
    seconds = spark.sql(f"SELECT unix_timestamp(TIMESTAMP'1970-01-01 00:00:00' + INTERVAL {horizon}) - unix_timestamp(TIMESTAMP'1970-01-01 00:00:00')").first()[0]
    # one text names a key: never null, and equal for equal values of any type
    key = F.to_json(F.struct(*on), {"ignoreNullFields": "false"}).alias("_key")
    at = (F.unix_millis(F.max(event_time)) if event_time else F.max(F.lit(None).cast("bigint"))).alias("_at")
    known = read_target(spark, target, stream.schema).groupBy(key).agg(at).groupBy("_key")
    state = _first_of_key(stream.columns, list(order), event_time, seconds * 1000)
    timed = rows.withColumn("_key", key).withColumn("_at", F.unix_millis(event_time) if event_time else F.lit(None).cast("bigint"))
    fresh = timed.groupBy("_key").transformWithState(state, stream.schema, "Append", "EventTime" if event_time else "None", known)

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch-{number:09d}-{tag}")

    tag = hashlib.sha256(checkpoint.encode()).hexdigest()[:8]
    return fresh.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Rows of each finished micro-batch, kept by query."""

    def __init__(self):
        self.rows: dict[str, list[int]] = {}

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.id)] = []

    def onQueryProgress(self, event) -> None:
        self.rows.setdefault(str(event.progress.id), []).append(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def cancellable(spark: SparkSession, tag: str):
    """Jobs started inside ``with`` can be ended by ``spark.interruptTag(tag)``; what they wrote before stays."""
    from contextlib import contextmanager

    @contextmanager
    def tagged():
        spark.addTag(tag)
        try:
            yield
        finally:
            spark.removeTag(tag)

    return tagged()
