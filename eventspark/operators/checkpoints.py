"""Cutting lineage in a place that survives the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="eventspark-checkpoint-")
    sc.setCheckpointDir(shared)


def pinned(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the checkpoint folder, so every later reader sees the same rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
