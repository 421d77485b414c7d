"""Cutting a plan's lineage with files that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only on a local master that sets none, a temporary folder."""
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
    """``df``, computed now and kept in the shared folder, without the plan that made it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
