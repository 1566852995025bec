"""Joins of a large table with a lookup table whose size is checked before it is broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000
SALTS = 32
NULL_KEY_SALTS = 1 << 30


def fits_broadcast(table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether the table has at most ``max_rows`` rows; reads no more than one row past that."""
    return table.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    *,
    known_rows: int | None = None,
    max_rows: int = MAX_BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join facts with a lookup table that holds each key at most once.

    ``known_rows`` states a bound the caller can prove (a limit, a list length); without it the size
    is counted. A table within the bound is broadcast. A larger one is joined by shuffle, with every
    fact row sent to one of ``salts`` copies of its key, so that a word which makes up a third of
    all text is spread over that many tasks.
    """
    small = known_rows <= max_rows if known_rows is not None else fits_broadcast(lookup, max_rows)
    if small:
        return facts.join(F.broadcast(lookup), on, how)
    columns = [c for c in facts.columns if c not in on]
    extra = [] if how in ("left_anti", "left_semi") else [c for c in lookup.columns if c not in on]
    # The salt follows from the row, so a recomputed task sends its rows to the same place again.
    # A null key matches nothing, so its rows need no copy to meet and are spread without a bound.
    has_key = reduce(Column.__and__, [F.col(c).isNotNull() for c in on])
    spread = F.when(has_key, F.lit(salts)).otherwise(F.lit(NULL_KEY_SALTS))
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), spread).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = salted.join(copies, [*on, "_salt"], how)
    return joined.select(*on, *columns, *extra)
