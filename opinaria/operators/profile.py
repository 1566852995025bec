"""Profiles of growing tables: counts and distinct counts kept per batch and merged without a rescan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A sketch keeps 2 ** SKETCH_BITS hashes at most (128 kB): exact up to that many distinct values, above
# them within 1.6 % in 95 of 100 cases, for one batch as for any number of merged ones.
SKETCH_BITS = 14


def sketched(df: DataFrame, *keys: str) -> DataFrame:
    """(keys…, columns): per group, for each column a struct of its type, rows, fill and sketch.

    One partial aggregate per task: what shuffles is one bounded row per task and group. Values are
    compared as strings; nulls count in ``rows`` only. Columns that Spark cannot cast to a string (maps,
    variants) are not taken; an empty table without keys gives one row of zeros.
    """
    columns = [c for c in df.columns if c not in keys]
    types = dict(df.dtypes)
    parts = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.count(F.lit(1)).alias("rows"),
            F.count(F.col(f"`{c}`")).alias("non_null"),
            F.theta_sketch_agg(F.col(f"`{c}`").cast("string"), SKETCH_BITS).alias("sketch"),
        )
        for c in columns
    ])
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(parts.alias("columns"))


def keep_profile(df: DataFrame, path: str, batch: str) -> None:
    """Profile one batch into its own folder; the same batch again replaces it, so a rerun adds nothing."""
    sketched(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def kept_profile(spark: SparkSession, path: str) -> DataFrame:
    """The profiles of all batches, one row each."""
    return spark.read.option("basePath", path).parquet(path)


def merged_profile(profiles: DataFrame) -> DataFrame:
    """(column, type, rows, non_null, distinct) of all profiled rows together.

    ``rows`` counts the rows of the batches that have the column. Of two types under one name both are
    reported.
    """
    return profiles.select(F.inline("columns")).groupBy("column", "type").agg(
        F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"),
        F.theta_sketch_estimate(F.theta_union_agg("sketch", SKETCH_BITS)).alias("distinct"),
    )
