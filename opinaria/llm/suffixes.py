"""Suffix-array dedup: bytes of texts that a fixed-length string covers which also starts earlier.

Suffixes are ordered by most-significant-digit passes and only to ``length`` bytes; equal groups are
exactly the repeated strings. Two things keep the first pass from moving every byte of the corpus:

* Of all suffixes, the chosen ones (least 48-byte hash among the suffixes of each window) go through
  the first digit; windows of a suffix whose digit occurs once are unique and need no more passes.
* Neighbouring windows with the same chosen suffix form a block, ordered as one. A block that also
  starts earlier settles all its windows; only the first copy of differing blocks goes on, window by
  window, through two digits of half the length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinaria.llm import arrays as A
from opinaria.llm import windows as W
from opinaria.llm.steps import written

CUT = A.struct_type(n_bytes="long", n_removed="long", n_spans="long", kept="binary", kept_sha256="string")


def blocks(docs: DataFrame, length: int, digit: int) -> DataFrame:
    """(h, block, _id, at, lo, hi): chosen suffixes, the windows lo..hi of each, a hash of their bytes."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.slices(whole, "_text"):
                values, lengths = W.units(batch["_text"], by_word=False)
                rolling = A.Rolling(values)
                got = A.choose(rolling, lengths, digit, length)
                start = A.starts_of(lengths)[got["doc"]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(A.signed(got["key"])), pa.array(A.signed(rolling.runs(got["lo"], got["hi"] + length))),
                    pa.array(np.asarray(batch["_id"])[got["doc"]]),
                    *(pa.array((got[c] - start).astype(np.int32)) for c in ("at", "lo", "hi")),
                ], names=["h", "block", "_id", "at", "lo", "hi"])

    return docs.mapInArrow(chosen, "h long, block long, _id long, at int, lo int, hi int")


def stretches(docs: DataFrame, ranges: DataFrame, length: int, digit: int, step: int = 8) -> DataFrame:
    """(_id, key, block, lo, hi): the windows lo..hi of each block in stretches of up to ``step``.

    Stretches are counted from the chosen suffix, so equal windows lie in stretches of one number. The
    key is the hash of the bytes that all windows of such a stretch share; the block is that of all
    its bytes here, where a block may end within a stretch.
    """
    packed = ranges.groupBy("_id").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("_blocks"))
    joined = docs.join(packed.hint("shuffle_hash"), "_id").select("_id", "_text", "_blocks")
    most = length - digit

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.slices(whole, "_text"):
                values, lengths = W.units(batch["_text"], by_word=False)
                rolling = A.Rolling(values)
                lists = batch["_blocks"]
                counts = np.diff(np.asarray(lists.offsets))
                start = np.repeat(A.starts_of(lengths), counts)
                at, lo, hi = (np.asarray(lists.flatten().field(i)).astype(np.int64) for i in range(3))
                # Number of the stretch of a window: windows start at most ``most`` before the suffix.
                number, owner = A.expand((lo - at + most) // step, (hi - at + most) // step)
                first = at[owner] - most + number * step
                base = start[owner]
                a, b = np.maximum(first, lo[owner]), np.minimum(first + step - 1, hi[owner])
                key = rolling.runs(base + first + step - 1, base + first + length)
                block = A.mix(rolling.runs(base + a, base + b + length) ^ (a - first).astype(np.uint64))
                ids = np.repeat(np.asarray(batch["_id"]), counts)[owner]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids), pa.array(A.signed(key)), pa.array(A.signed(block)),
                    pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)),
                ], names=["_id", "key", "block", "lo", "hi"])

    return joined.mapInArrow(hashed, "_id long, key long, block long, lo int, hi int")


def repeated_ranges(docs: DataFrame, length: int = 100, digit: int = 48) -> DataFrame:
    """(_id, lo, hi): half-open byte ranges covered by strings of ``length`` bytes that start earlier.

    ``docs`` has _id and _text. Passes: the digit of the chosen suffixes, blocks, first half of a
    window, second half. Groups of one leave after each pass.
    """
    rows = blocks(docs, length, digit)
    twice = rows.select("h").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    kept = written(rows.join(twice.hint("merge"), "h"), "suffix-blocks")
    at = F.struct("_id", "lo")
    by_block = written(kept.groupBy("h", "block").agg(F.min(at).alias("first")), "suffix-firsts")
    several = by_block.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    placed = kept.join(by_block.hint("merge"), ["h", "block"]).filter(at > F.col("first"))
    settled = placed.select("_id", "lo", (F.col("hi") + length).alias("hi"))
    firsts = kept.groupBy("h", "block").agg(F.min(F.struct("_id", "lo", "at", "hi")).alias("f"))
    open_blocks = firsts.join(several.hint("merge"), "h").select("f._id", "f.at", "f.lo", "f.hi")
    parts = written(stretches(docs, open_blocks, length, digit), "suffix-stretches")
    classes = written(parts.groupBy("key", "block").agg(F.min(at).alias("first")), "suffix-classes")
    mixed = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    classed = written(parts.join(classes.hint("merge"), ["key", "block"]), "suffix-classed")
    settled = settled.unionByName(classed.filter(at > F.col("first")).select(
        "_id", "lo", (F.col("hi") + length).alias("hi")))
    open_rows = classed.filter(at == F.col("first")).join(mixed.hint("merge"), "key").select("_id", "lo", "hi")
    suffixes = written(W.window_rows(docs, open_rows, length, by_word=False), "suffix-windows")
    pass_1 = suffixes.groupBy("d1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("d1")
    left = written(suffixes.join(pass_1.hint("merge"), "d1"), "suffix-pass")
    pass_2 = left.groupBy("d1", "d2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_id", "at")).alias("first")).filter("n > 1")
    equal = left.join(pass_2.hint("merge"), ["d1", "d2"]).filter(F.struct("_id", "at") > F.col("first"))
    return written(settled.unionByName(
        equal.select("_id", F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))), "suffix-ranges")


@F.arrow_udf(CUT)
def cut_bytes(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    out = []
    for i, text in enumerate(texts.to_pylist()):
        data = (text or "").encode()
        lo, hi = W.ranges_of(ranges, i)
        edges = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(data)]
        kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if len(lo) else data
        out.append((len(data), len(data) - len(kept), len(lo), kept, hashlib.sha256(kept).hexdigest()))
    return A.struct_rows(out, CUT)


def remove_repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, digit: int = 48,
) -> DataFrame:
    """Every column of ``docs`` as struct ``row``, and what is left of its text as struct ``cut``.

    A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a text of a
    smaller id, or in the same text before. Strings never cross texts and are judged on the input.
    Null texts count as empty; texts shorter than ``length`` stay. Rows whose id is null are neither
    compared nor changed. Rows of one id count as one document: what is found in one is cut in all.
    An empty table gives an empty table; other columns pass through whatever their names.
    """
    ranges = repeated_ranges(W.keyed(docs, id_col, text_col), length, digit)
    rows = W.with_ranges(docs, ranges, id_col)
    text = F.col("_row").getField(text_col).cast("string")
    return rows.select(F.col("_row").alias("row"), cut_bytes(text, F.col("_ranges")).alias("cut"))


def query(docs: DataFrame) -> DataFrame:
    done = remove_repeated_bytes(docs.select("doc_id", "text"))
    return done.select("row.doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256")
