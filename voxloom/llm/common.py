"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

T = TypeVar("T")
#: Bytes of one Arrow batch sent to a Python worker; bounds a worker's memory however long the texts are.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, shared by the driver and all executors.

    Only where that setting is absent and the master is local, as in tests, a temporary folder takes its place.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; smaller than a checkpoint where values repeat.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_few(df: DataFrame, most_rows: int) -> DataFrame:
    """``df``, a written table, for a broadcast if it has at most ``most_rows`` rows; else Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= most_rows else df


def two_hashes(text: Column) -> tuple[Column, Column]:
    """128 bits of hash, as two longs."""
    return F.xxhash64(text), F.xxhash64(F.lit("line"), text)


def id_bucket(column: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo the number of buckets; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % buckets


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most about BATCH_BYTES.

    Spark takes the bound from the session when the job runs; where the user has set none, it is lowered for the session.
    Results do not depend on it.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound) == "67108864b":  # Spark's default
        spark.conf.set(bound, str(BATCH_BYTES))


_model: dict[str, object] = {}


def only_model(name: str, make: Callable[[], T]) -> T:
    """What ``make`` makes, once for each name; a worker holds one model at a time.

    Spark uses a worker again for the stages that follow, so without this it would hold the models of all of them.
    """
    if name not in _model:
        _model.clear()
        give_back()
        _model[name] = make()
    return _model[name]


def give_back() -> None:
    """Give memory that is free, but still a worker's, back to the machine."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with bounded batches, one call of ``work`` for each. A worker that waits for its next task gives back
    what it does not use."""
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(batch)
        give_back()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def kind(df: DataFrame, column: str) -> str:
    """DDL type of a column."""
    return df.schema[column].dataType.simpleString()
