"""Steps of a long job: each is written once, and what only led to it is given up."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame

from opinaria.sources.scratch import materialise


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder; the shuffle files behind it may go at once.

    Spark drops the shuffle files of a plan when the driver collects the plan as garbage, which a
    driver with little to do may put off until the disks of its executors are full.
    """
    out = materialise(df, name)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out
