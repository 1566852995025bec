"""Parquet tables as scan inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The named columns of a Parquet table; the scan reads no others."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def spread(table: DataFrame, key: str) -> DataFrame:
    """Distribute a scan that has fewer pieces than there are cores; larger scans stay as read.

    Only an input of a few files or row groups is shuffled here, and hashing it on the row id also
    serves the per-document aggregates that follow.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores, key)
