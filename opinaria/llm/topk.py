"""Exact top-k search by inner product: global score histograms, refined down to each query's kth score.

Queries go out in blocks of bounded size, and every block meets all rows. A round deals the scores
inside a query's current range into bins; the merged histogram names the bin of the kth score, which
is the range of the next round, until a bin is one score wide. A last pass takes what lies above, and
of the rows at the kth score those with the least ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinaria.llm.steps import written
from opinaria.llm.vectors import EXACT, SCALE, greatest, integer_vectors, matrices
from opinaria.operators.row_ids import with_row_ids
from opinaria.sources.scratch import new_path

TOP, BIN_BITS = 5, 11
# Of queries sent to the tasks at once, of rows scored by one task, and of scores held at once.
QUERY_BLOCK, TASK_ROWS, TILE = 4096, 16_384, 1 << 20
RESULT = "query_no long, query_id long, rank int, vec_id long, score long"


@dataclass
class Block:
    """Queries of one width: ``low`` and ``need`` say where each one's search stands.

    ``low`` is the least score of the current range, and ``need`` how many rows are still to be found
    at or below the range's upper end.
    """

    numbers: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    need: np.ndarray


def score_bound(width: int, most: int) -> int:
    """No inner product of integers up to ``most`` is greater."""
    bound = width * most * most
    if bound >= 1 << 62:
        raise OverflowError("scores do not fit into 64 bits")
    return bound


def scores(block: Block, x: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(exact scores by query and row, which of them count): a query's own id does not."""
    kind = np.float64 if score_bound(x.shape[1], most) < EXACT else np.int64
    found = (block.vectors.astype(kind) @ x.astype(kind).T).astype(np.int64)
    counts = np.ones(found.shape, dtype=bool)
    for at in np.flatnonzero(np.isin(ids, block.ids)):
        counts[block.ids == ids[at], at] = False
    return found, counts


def _tiles(batches: Iterator[pa.RecordBatch], blocks: dict[int, Block]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, ids, vectors) of rows that have queries of their width, few enough to score at once."""
    for batch in batches:
        ids = np.asarray(batch["_id"]).astype(np.int64)
        for width, at, x in matrices(batch):
            if width in blocks:
                step = max(1, TILE // len(blocks[width].ids))
                for a in range(0, len(x), step):
                    yield width, ids[at[a : a + step]], x[a : a + step]


def _largest(values: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row, in any order."""
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k :] if values.shape[1] > k else values


def histogram(candidates: DataFrame, blocks: dict[int, Block], end: int, shift: int, most: int, k: int) -> DataFrame:
    """(query_no, bin, n): the upper end of every query's score histogram.

    The range has 2^end scores from ``low`` on, and a bin 2^shift of them. A task sends a query's bins from the top until they hold k rows: the
    bin of the kth score over all tasks is never lower than that.
    """
    shared = candidates.sparkSession.sparkContext.broadcast(blocks)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        top = {w: np.full((len(b.ids), 0), -1, np.int64) for w, b in blocks.items()}
        for width, ids, x in _tiles(batches, blocks):
            block = blocks[width]
            found, counts = scores(block, x, ids, most)
            bins = (found - block.low[:, None]) >> shift
            bins[~counts | (bins < 0) | (bins >> (end - shift) > 0)] = -1
            top[width] = _largest(np.concatenate([top[width], bins], axis=1), k)
        for width, bins in top.items():
            query, at = np.nonzero(bins >= 0)
            if len(query):
                keys, n = np.unique((query << BIN_BITS) | bins[query, at], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks[width].numbers[keys >> BIN_BITS]), pa.array((keys & ((1 << BIN_BITS) - 1)).astype(np.int32)),
                     pa.array(n.astype(np.int64))], names=["query_no", "bin", "n"])

    rows = candidates.mapInArrow(counted, "query_no long, bin int, n long")
    return rows.groupBy("query_no", "bin").agg(F.sum("n").alias("n"))


def kth_bins(bins: DataFrame, need: Column) -> DataFrame:
    """(query_no, bin, above): the bin of the last wanted row, and how many rows lie in higher ones.

    A query has at most 2^BIN_BITS bins.
    """
    above = F.sum("n").over(Window.partitionBy("query_no").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1))
    placed = bins.withColumn("above", F.coalesce(above, F.lit(0)))
    return placed.filter((F.col("above") < need) & (F.col("above") + F.col("n") >= need)).select("query_no", "bin", "above")


def narrowed(candidates: DataFrame, blocks: dict[int, Block], most: int, k: int) -> None:
    """Moves every query's ``low`` to its kth score and ``need`` to the rows wanted at that score.

    A query with fewer than k rows to choose from keeps the least possible score.
    """
    session = candidates.sparkSession
    places = {int(q): (w, i) for w, b in blocks.items() for i, q in enumerate(b.numbers)}
    span = max(2 * score_bound(w, most) for w in blocks)
    end = span.bit_length()
    while True:
        shift = max(0, end - BIN_BITS)
        wanted = session.createDataFrame(
            [(int(q), int(n)) for b in blocks.values() for q, n in zip(b.numbers, b.need, strict=True)], "query_no long, need long")
        bins = histogram(candidates, blocks, end, shift, most, k).join(F.broadcast(wanted), "query_no")
        # At most one row per query of the block.
        for r in kth_bins(bins, F.col("need")).collect():
            width, at = places[r["query_no"]]
            blocks[width].low[at] += r["bin"] << shift
            blocks[width].need[at] -= r["above"]
        if shift == 0:
            return
        end = shift


def selected(candidates: DataFrame, blocks: dict[int, Block], most: int, k: int) -> DataFrame:
    """Rows above each query's kth score, and the least ids at it; a task sends at most k rows per query."""
    shared = candidates.sparkSession.sparkContext.broadcast(blocks)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        none = np.zeros(0, np.int64)
        kept = {w: (none, none, none) for w in blocks}
        for width, ids, x in _tiles(batches, blocks):
            found, counts = scores(blocks[width], x, ids, most)
            query, at = np.nonzero(counts & (found >= blocks[width].low[:, None]))
            parts = zip(kept[width], (query, found[query, at], ids[at]), strict=True)
            query, score, own = (np.concatenate(p) for p in parts)
            order = np.lexsort((own, -score, query))
            query = query[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            order, query = order[place < k], query[place < k]
            kept[width] = query, score[order], own[order]
        for width, (query, score, own) in kept.items():
            block = blocks[width]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.numbers[query]), pa.array(block.ids[query]), pa.array(own), pa.array(score)],
                names=["query_no", "query_id", "vec_id", "score"])

    rows = candidates.mapInArrow(chosen, "query_no long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_no", "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _blocks(rows: list, most: int, k: int) -> dict[int, Block]:
    made: dict[int, Block] = {}
    for width in sorted({r["width"] for r in rows}):
        own = [r for r in rows if r["width"] == width]
        batch = pa.RecordBatch.from_pydict({"width": [width] * len(own), "x": pa.array([bytes(r["x"]) for r in own], pa.binary())})
        vectors = np.zeros((len(own), width), np.int64)
        for _, at, x in matrices(batch):
            vectors[at] = x
        made[width] = Block(
            np.array([r["row_id"] for r in own], np.int64), np.array([r["_id"] for r in own], np.int64), vectors,
            np.full(len(own), -score_bound(width, most), np.int64), np.full(len(own), k, np.int64))
    return made


def _greatest_entries(rows: DataFrame) -> tuple[int, int]:
    """(number of rows, greatest absolute entry)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = max((greatest(x) for _, _, x in matrices(batch)), default=0)
            if most >= 1 << 63:
                raise OverflowError("scores do not fit into 64 bits")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64()), "most": pa.array([most], pa.int64())})

    total = rows.mapInArrow(found, "n long, most long").agg(F.sum("n").alias("n"), F.max("most").alias("most")).first()
    return total["n"] or 0, total["most"] or 0


def search(
    df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    k: int = TOP, scale: int = SCALE, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_no, query_id, rank, vec_id, score): each query row's k best rows among all others.

    ``is_query`` is a condition on ``_id``. Scores are exact integers; ties go to the smaller id. Rows
    without an id, and null vectors or vectors with null or non-finite entries, take no part; vectors
    of different widths never meet. Rows that share a query's id are no candidates for it; rows that
    repeat an id are candidates (and queries, told apart by ``query_no``) of their own. With fewer
    than k others a query gets them all, with none no row; an empty table gives an empty one. Other
    columns are not read. Scores beyond 64 bits are an error.
    """
    session = df.sparkSession
    rows = written(integer_vectors(df.filter(F.col(f"`{id_col}`").isNotNull()), id_col, vector_col, scale), "topk-rows")
    n, most = _greatest_entries(rows)
    # Scoring costs far more than reading, so the rows are dealt by their number, not by their bytes.
    candidates = rows.repartition(max(session.sparkContext.defaultParallelism, -(-n // TASK_ROWS)))
    numbered = written(with_row_ids(rows.filter(is_query), "_id", "width", "x", name="row_id"), "topk-queries")
    path = new_path(session, "topk-found")
    session.createDataFrame([], RESULT).write.parquet(path)
    for first in range(0, numbered.count(), query_block):
        # Bounded: at most ``query_block`` vectors at a time.
        asked = numbered.filter(F.col("row_id").between(first + 1, first + query_block)).collect()
        blocks = _blocks(asked, most, k)
        narrowed(candidates, blocks, most, k)
        selected(candidates, blocks, most, k).write.mode("append").parquet(path)
    return session.read.schema(RESULT).parquet(path)


def query(embeddings: DataFrame) -> DataFrame:
    found = search(embeddings, F.col("_id") % 50 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 50 = 0),
r AS (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
