"""The most frequent terms, exactly, without sending every term of the corpus through a shuffle.

Each task keeps a bounded summary of its terms (Misra and Gries 1982, in the mergeable form): a count
that is never too high, and one number by which any count of the task may be too low. Summed over the
tasks these give bounds for every term, seen or not. Terms that may be among the first k are counted
again exactly; where the bounds do not separate them, all terms are counted instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinaria.operators.dimension import MAX_BROADCAST_ROWS, lookup_join
from opinaria.operators.tokens import MAX_FEATURES, MIN_TERM_LENGTH, term_frequencies, term_rows, top_terms
from opinaria.sources.scratch import materialise

# Terms that a task keeps. A count is too low by at most (words of the task) / CAPACITY.
CAPACITY = 200_000


def summed(tables: list[pa.Table]) -> pa.Table:
    """(term, low): counts of equal terms added up."""
    whole = pa.concat_tables(tables).group_by("term").aggregate([("low", "sum")])
    return whole.rename_columns({"low_sum": "low"}).select(["term", "low"])


def cut_to(table: pa.Table, capacity: int) -> tuple[pa.Table, int]:
    """At most ``capacity`` terms, and what was taken off every count to get there."""
    if table.num_rows <= capacity:
        return table, 0
    low = table["low"].to_numpy()
    # The greatest count that is left out: at least capacity + 1 counts lose that much.
    off = int(np.partition(low, len(low) - capacity - 1)[len(low) - capacity - 1])
    table = table.set_column(1, "low", pa.array(low - off))
    return table.filter(pc.greater(table["low"], 0)), off


def summaries(df: DataFrame, words: str = "words", capacity: int = CAPACITY) -> DataFrame:
    """(term, low, error): the kept terms of every task, and one row without a term that has its error."""
    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = pa.table({"term": pa.array([], pa.string()), "low": pa.array([], pa.int64())})
        waiting, size, error = [], 0, 0
        for batch in batches:
            terms = pc.list_flatten(batch.column(0)).cast(pa.string())
            counts = pc.value_counts(terms.filter(pc.greater_equal(pc.utf8_length(terms), MIN_TERM_LENGTH)))
            new = pa.table({"term": counts.field("values"), "low": counts.field("counts")})
            waiting.append(new)
            size += new.num_rows
            if size > capacity:
                kept, off = cut_to(summed([kept, *waiting]), capacity)
                waiting, size, error = [], 0, error + off
        kept, off = cut_to(summed([kept, *waiting]), capacity)
        names = ["term", "low", "error"]
        for part in kept.to_batches(max_chunksize=10_000):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(part.num_rows, pa.int64())], names=names)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([error + off], pa.int64())], names=names)

    return df.select(words).mapInArrow(summarised, "term string, low long, error long")


def heavy_terms(
    df: DataFrame, k: int = MAX_FEATURES, words: str = "words", capacity: int = CAPACITY,
    max_candidates: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """(term, n) of the k most frequent terms; equal counts in alphabetical order, as in ``top_terms``.

    The same rows as from a count of all terms, always. What shuffles is at most ``capacity`` terms per
    task; what is broadcast is at most ``max_candidates`` terms, else all terms are counted. Null and
    empty word arrays add nothing; an empty table has no terms.
    """
    made = materialise(summaries(df, words, capacity), "term-summaries")
    error = made.agg(F.sum("error")).first()[0] or 0
    lows = made.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("low").alias("n"))
    if error == 0:
        # No task dropped anything, so the counts are exact.
        return top_terms(lows, k)
    lows = materialise(lows, "term-bounds")
    found = top_terms(lows, k).agg(F.count("*").alias("n"), F.min("n").alias("least")).first()
    # A term that no task kept occurs at most ``error`` times. It must fall short of the kth count.
    if found["n"] < k or found["least"] <= error:
        return top_terms(term_frequencies(df, words), k)
    candidates = lows.filter(F.col("n") + error >= found["least"]).select("term")
    size = candidates.limit(max_candidates + 1).count()
    if size > max_candidates:
        return top_terms(term_frequencies(df, words), k)
    counted = lookup_join(term_rows(df, words=words), candidates, ["term"], known_rows=size)
    return top_terms(counted.groupBy("term").agg(F.count("*").alias("n")), k)
