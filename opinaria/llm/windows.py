"""Windows of one length that occur again: the parts that byte and word deduplication share.

Chosen k-mers (the least hash in each window) name the few places at which equal windows can be;
only windows around repeated ones are hashed as rows. A text travels to its ranges by one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinaria.llm import arrays as A

RANGE = "array<struct<lo:int,hi:int>>"


def units(texts: pa.Array, by_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash values of the words or bytes of the texts, and the number in each text."""
    if by_word:
        words, lengths = A.text_words(texts)
        return A.mix(A.hash_words(words)), lengths
    data, lengths = A.text_bytes(texts)
    return A.BYTE_VALUES[data], lengths


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id long, _text): no other column can clash from here on; rows without an id are left out."""
    return docs.select(
        F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")
    ).filter("_id IS NOT NULL")


def window_rows(docs: DataFrame, ranges: DataFrame, window: int, by_word: bool) -> DataFrame:
    """(_id, at, d1, d2) for every window that ``ranges`` (_id, lo, hi: closed) names.

    d1 and d2 are the window's digits: hashes of its first and its second half. Ranges of one text are
    gathered in one row, as many as the text has places.
    """
    half = window // 2
    packed = ranges.groupBy("_id").agg(F.collect_list(F.struct("lo", "hi")).cast(RANGE).alias("_ranges"))
    joined = docs.join(packed.hint("shuffle_hash"), "_id").select("_id", "_text", "_ranges")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.slices(whole, "_text"):
                values, lengths = units(batch["_text"], by_word)
                lists = batch["_ranges"]
                flat = lists.flatten()
                counts = np.diff(np.asarray(lists.offsets))
                start = np.repeat(A.starts_of(lengths), counts)
                lo, hi = (np.asarray(flat.field(i)).astype(np.int64) + start for i in (0, 1))
                at, owner = A.expand(lo, hi)
                rolling = A.Rolling(values)
                ids = np.repeat(np.asarray(batch["_id"]), counts)[owner]
                for a in range(0, len(at), 200_000):
                    p, own = at[a : a + 200_000], owner[a : a + 200_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[a : a + 200_000]), pa.array((p - start[own]).astype(np.int32)),
                        pa.array(A.signed(rolling.runs(p, p + half))),
                        pa.array(A.signed(rolling.runs(p + half, p + window))),
                    ], names=["_id", "at", "d1", "d2"])

    return joined.mapInArrow(hashed, "_id long, at int, d1 long, d2 long")


def with_ranges(docs: DataFrame, ranges: DataFrame, id_col: str) -> DataFrame:
    """All columns of the documents as ``_row``, and the ranges (half-open) of each in ``_ranges``."""
    packed = ranges.groupBy("_id").agg(F.collect_list(F.struct("lo", "hi")).cast(RANGE).alias("_ranges"))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.struct("*").alias("_row"))
    return rows.join(packed.hint("shuffle_hash"), "_id", "left").select("_row", "_ranges")


def ranges_of(lists: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged ranges of one row."""
    got = lists[row]
    if not got.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values = got.values
    return A.merged(*(np.asarray(values.field(i)).astype(np.int64) for i in (0, 1)))
