"""Intermediate tables that must outlive an executor: written below the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the session names; only a local session may fall back to a temporary one."""
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder which all executors share")
    folder = tempfile.mkdtemp(prefix="scratch-")
    context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the scratch folder which no other run uses."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a DataFrame, partition by partition."""
    scratch_root(df.sparkSession)
    return df.checkpoint()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame once and read it back, for results which several jobs use."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
