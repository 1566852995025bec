"""Substring dedup on a de Bruijn graph of the words.

Chosen k-mers of words (the least hash in each window) are the edges. Edges that occur in one document
only are dropped; where an edge is always followed by the same edge, and that one always preceded by
it, the two belong to one path. A path occurs whole wherever one of its edges does, so the smallest
document id of a path is the source of each window inside it. Windows that stick out of a path
are compared by their words' hashes. A walk around one edge, as a text makes that repeats a few words
over and over, is one row, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinaria.llm import arrays as A
from opinaria.llm import windows as W
from opinaria.llm.steps import written

CUT = A.struct_type(n_words="long", n_removed="long", kept="string", kept_sha256="string")
EDGES = "h long, next long, link long, _id long, ord int, at int, lo int, hi int, upto int"


def edges(docs: DataFrame, window: int, k: int) -> DataFrame:
    """One row per chosen k-mer: its hash h, the next chosen one, a hash of the words over both.

    Windows lo..hi chose it. Where it follows itself over equal windows, the first row stands for all
    that go on to it once more, and ``upto`` is the last window of these; elsewhere it is hi.
    """

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.slices(whole, "_text"):
                values, lengths = W.units(batch["_text"], by_word=True)
                rolling = A.Rolling(values)
                got = A.choose(rolling, lengths, k, window)
                doc, at = got["doc"], got["at"]
                if not len(doc):
                    continue
                start = A.starts_of(lengths)[doc]
                last = np.concatenate([doc[1:] != doc[:-1], [True]])
                follows = np.concatenate([at[1:], [0]])
                link = rolling.runs(at, np.where(last, at, follows) + k)
                first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                order = np.arange(len(doc)) - np.repeat(first, np.diff([*first, len(doc)]))
                nexts = np.concatenate([got["key"][1:], [0]]).astype(np.uint64)
                block = rolling.runs(got["lo"], got["hi"] + window)
                again = ~last[1:] & ~last[:-1]
                for x in (got["key"], link, block):
                    again &= x[1:] == x[:-1]
                one = np.flatnonzero(np.concatenate([[True], ~again]))
                upto = got["hi"][np.concatenate([one[1:], [len(doc)]]) - 1]
                small = [(x - start[one]).astype(np.int32) for x in (at[one], got["lo"][one], got["hi"][one], upto)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(A.signed(got["key"][one])), pa.array(A.signed(nexts[one]), mask=last[one]),
                    pa.array(A.signed(link[one]), mask=last[one]), pa.array(np.asarray(batch["_id"])[doc[one]]),
                    pa.array(order[one].astype(np.int32)), *map(pa.array, small),
                ], names=["h", "next", "link", "_id", "ord", "at", "lo", "hi", "upto"])

    return docs.mapInArrow(A.tidy(chosen), EDGES)


def repeated_edges(docs: DataFrame, window: int, k: int) -> DataFrame:
    rows = edges(docs, window, k)
    shared = rows.groupBy("h").agg(F.min("_id").alias("a"), F.max("_id").alias("b")).filter("a < b")
    return written(rows.join(shared.select("h").hint("merge"), "h"), "word-edges")


def compact(occurrences: DataFrame) -> DataFrame:
    """(h, joins): whether an edge always goes on to one edge that is always reached from it."""
    out = occurrences.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.count("link").alias("n_on"), F.min("link").alias("link"),
        F.max("link").alias("link_2"), F.min("next").alias("next"))
    into = occurrences.filter("link IS NOT NULL").groupBy("next").agg(
        F.count(F.lit(1)).alias("n_in"), F.min("link").alias("in_1"), F.max("link").alias("in_2"))
    one_way = out.filter("n = n_on AND link = link_2").select("h", "next")
    entered = into.filter("in_1 = in_2").select("next", "n_in")
    sizes = out.select(F.col("h").alias("next"), F.col("n").alias("n_next"))
    both = one_way.join(entered, "next").join(sizes, "next").filter("n_in = n_next")
    return both.select("h", F.lit(True).alias("joins"))


def paths(occurrences: DataFrame, k: int) -> DataFrame:
    """(_id, head, start, end, lo, hi, upto): each walk of a document along one path, in words.

    An edge that goes on to itself joins none, so a row that stands for several is a walk of its own.
    """
    joins = written(compact(occurrences), "word-joins")
    marked = occurrences.join(joins.hint("merge"), "h", "left").select(
        "_id", "ord", "h", "at", "lo", "hi", "upto", F.coalesce("joins", F.lit(False)).alias("joins"))
    by_place = Window.partitionBy("_id").orderBy("ord")
    begins = ~F.coalesce(F.lag("joins").over(by_place), F.lit(False))
    walks = marked.withColumn("walk", F.sum(begins.cast("int")).over(by_place))
    ends = walks.groupBy("_id", "walk").agg(
        F.min(F.struct("ord", "h", "at", "lo")).alias("a"), F.max(F.struct("ord", "at", "hi", "upto")).alias("b"))
    return written(ends.select(
        "_id", F.col("a.h").alias("head"), F.col("a.at").alias("start"), (F.col("b.at") + k).alias("end"),
        F.col("a.lo").alias("lo"), F.col("b.hi").alias("hi"), F.col("b.upto").alias("upto")), "word-paths")


def side_rows(docs: DataFrame, sides: DataFrame, window: int) -> DataFrame:
    """(_id, key, block, lo, upto): for the windows lo..hi that stick out of a path, a hash of all their words.

    The windows from there to ``upto`` repeat them.
    Only texts with the same key can share any of them: the window next to the path for a side of a
    path that is itself a window long (near >= 0), and the path for a shorter one, which has one side.
    """
    packed = sides.groupBy("_id").agg(F.collect_list(F.struct("lo", "hi", "near", "head", "upto")).alias("_sides"))
    joined = docs.join(packed.hint("shuffle_hash"), "_id").select("_id", "_text", "_sides")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.slices(whole, "_text"):
                values, lengths = W.units(batch["_text"], by_word=True)
                rolling = A.Rolling(values)
                lists = batch["_sides"]
                counts = np.diff(np.asarray(lists.offsets))
                flat = lists.flatten()
                lo, hi, near, head, upto = (np.asarray(flat.field(i)).astype(np.int64) for i in range(5))
                start = np.repeat(A.starts_of(lengths), counts)
                block = rolling.runs(start + lo, start + hi + window)
                beside = start + np.where(near < 0, lo, near)
                key = np.where(near < 0, head, A.signed(rolling.runs(beside, beside + window)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.asarray(batch["_id"]), counts)), pa.array(key), pa.array(A.signed(block)),
                    pa.array(lo.astype(np.int32)), pa.array(upto.astype(np.int32)),
                ], names=["_id", "key", "block", "lo", "upto"])

    return joined.mapInArrow(A.tidy(hashed), "_id long, key long, block long, lo int, upto int")


def repeated_ranges(docs: DataFrame, window: int = 50, k: int = 25) -> DataFrame:
    """(_id, lo, hi): half-open word ranges covered by windows that also start in a smaller id."""
    found = paths(repeated_edges(docs, window, k), k)
    source = found.groupBy("head").agg(F.min(F.struct("_id", "start", "end")).alias("src"))
    placed = found.join(source.hint("merge"), "head").filter(
        (F.col("_id") > F.col("src._id")) & (F.col("end") - F.col("start") == F.col("src.end") - F.col("src.start")))
    long_path = F.col("end") - F.col("start") >= window
    inside = placed.filter(long_path).select(
        "_id", F.col("start").alias("lo"), (F.col("end") + F.col("upto") - F.col("hi")).alias("hi"))
    # Windows lo..hi chose an edge of the path; those from start to end - window lie inside it.
    none = F.lit(-1).alias("near")
    left_hi = F.least(F.col("start") - 1, F.col("hi"))
    left = F.struct(F.col("lo").alias("lo"), left_hi.alias("hi"), (F.col("start") - 1).alias("near"),
                    left_hi.alias("upto"))
    right = F.struct(F.greatest(F.col("end") - window + 1, F.col("lo")).alias("lo"), F.col("hi").alias("hi"),
                     (F.col("end") - window + 1).alias("near"), F.col("hi").alias("upto"))
    around = F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"), none, F.col("upto").alias("upto"))
    sides = found.select("_id", "head", F.inline(F.when(long_path, F.array(left, right)).otherwise(
        F.array(around)))).filter("lo <= hi")
    rows = written(side_rows(docs, sides, window), "word-sides")
    classes = written(rows.groupBy("key", "block").agg(F.min("_id").alias("first")), "word-classes")
    several = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    classed = rows.join(classes.hint("merge"), ["key", "block"])
    settled = classed.filter("_id > first").select("_id", "lo", (F.col("upto") + window).alias("hi"))
    # What the smallest id of a class has is compared with other classes window by window.
    open_rows = classed.filter("_id = first").join(several.hint("merge"), "key").select(
        "_id", "lo", F.col("upto").alias("hi")).distinct()
    windows = written(W.window_rows(docs, open_rows, window, by_word=True), "word-windows")
    first = windows.groupBy("d1", "d2").agg(F.min("_id").alias("a"), F.max("_id").alias("b")).filter("a < b")
    equal = windows.join(first.hint("merge"), ["d1", "d2"]).filter("_id > a")
    return written(inside.unionByName(settled).unionByName(
        equal.select("_id", F.col("at").alias("lo"), (F.col("at") + window).alias("hi"))), "word-ranges")


@F.arrow_udf(CUT)
def cut_words(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    out = []
    for i, text in enumerate(texts.to_pylist()):
        words = (text or "").encode().split()
        lo, hi = W.ranges_of(ranges, i)
        edges_ = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(words)]
        kept = [w for a, b in zip(edges_[::2], edges_[1::2], strict=True) for w in words[a:b]] if len(lo) else words
        joined = b" ".join(kept)
        out.append((len(words), len(words) - len(kept), joined.decode(), hashlib.sha256(joined).hexdigest()))
    return A.struct_rows(out, CUT)


def remove_repeated_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, k: int = 25,
) -> DataFrame:
    """Every column of ``docs`` as struct ``row``, and what is left of its words as struct ``cut``.

    A word goes if a window of ``window`` words covers it that also starts in a text of a smaller id;
    windows are judged on the input. Null texts have no words; shorter texts stay whole. Rows whose id
    is null are neither compared nor changed. Rows of one id count as one document: what is found in
    one is cut in all. An empty table gives an empty table; other columns pass through.
    """
    ranges = repeated_ranges(W.keyed(docs, id_col, text_col), window, k)
    rows = W.with_ranges(docs, ranges, id_col)
    text = F.col("_row").getField(text_col).cast("string")
    return rows.select(F.col("_row").alias("row"), cut_words(text, F.col("_ranges")).alias("cut"))


def query(docs: DataFrame) -> DataFrame:
    done = remove_repeated_words(docs.select("doc_id", "text"))
    return done.select("row.doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256")


# Windows by their words themselves; DuckDB holds them all, so this is for small tables.
ORACLE_SQL = r"""WITH w AS (SELECT doc_id,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS p FROM w),
    windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM places),
    first AS (SELECT h, min(doc_id) AS a FROM windows GROUP BY h),
    hit AS (SELECT doc_id, p FROM windows JOIN first USING (h) WHERE doc_id > a),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM hit),
    every AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS body
        FROM every ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
        sha256(coalesce(body, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
