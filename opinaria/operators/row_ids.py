"""Dense 1-based row ids in a stated order, without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinaria.operators.dimension import lookup_join
from opinaria.sources.scratch import checkpoint

# monotonically_increasing_id() puts the partition above this many bits, the row within it below.
ROW_BITS = 33


def with_row_ids(df: DataFrame, *order: str | Column, name: str = "id") -> DataFrame:
    """Number the rows 1, 2, 3, … in ``order``, which must be total.

    A range sort cuts the rows into ordered partitions, and a checkpoint fixes that cut, so that
    counting and numbering see the same one even after an executor is lost. Each row then needs
    only the number of rows in earlier partitions: one value per partition, broadcast.
    """
    cut = checkpoint(df.orderBy(*order)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", ROW_BITS)
    sizes = cut.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # At most one row per partition reaches this window.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        cut.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select((F.col("_before") + within + 1).alias(name), *df.columns)
    )


def with_row_ids_within(
    df: DataFrame, group: str, *order: str | Column, name: str = "id"
) -> DataFrame:
    """Number the rows of every group 1, 2, 3, …; a group of any size is sorted by many tasks.

    Rows are numbered as a whole in (group, order), and each group's first number is taken off.
    """
    numbered = with_row_ids(df, group, *order, name="_id")
    first = numbered.groupBy(group).agg(F.min("_id").alias("_first"))
    return lookup_join(numbered, first, [group]).select(
        (F.col("_id") - F.col("_first") + 1).alias(name), *df.columns
    )
