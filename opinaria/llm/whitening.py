"""Whitening of embeddings: exact covariance in one distributed sum, components by spectral division.

Vectors are integers (``vectors``). Counts, sums and products are sums of integers, so neither the
order of tasks nor a repeated task changes them. Products are taken of vectors centred at the integer
nearest to the mean, and the rest of the centring is an exact correction, so the covariance is right
to the last bit whatever the mean. The model (one row per component) is broadcast to the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinaria.llm.spectral import leading
from opinaria.llm.steps import written
from opinaria.llm.vectors import EXACT, SCALE, greatest, integer_vectors, matrices

COMPONENTS = 4
# The driver holds width * width numbers for each width that occurs.
MOST_WIDTHS, MOST_WIDTH = 16, 4096


@dataclass(frozen=True)
class Whitening:
    """Fitted on ``n`` distinct vectors with the given sums; ``axes`` are unit columns."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, from the exact n*x - S where that fits into 64 bits."""
        return (self.scaled(x) / self.n).astype(np.float64)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact: 64-bit integers, or Python's where those do not reach."""
        most = self.n * greatest(x) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < EXACT else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """The sum over dimensions of (n*x - S)^2."""
        apart = self.scaled(x)
        most = greatest(apart) ** 2 * max(1, x.shape[1])
        if most >= 1 << 63:
            sums = (apart.astype(object) ** 2).sum(axis=1)
            if len(sums) and max(sums) >= 1 << 63:
                raise OverflowError("a deviation does not fit into 64 bits")
            return sums.astype(np.int64)
        return (apart.astype(np.int64) ** 2).sum(axis=1)


def _column_sums(x: np.ndarray) -> np.ndarray:
    safe = greatest(x) * max(1, len(x)) < 1 << 62
    return (x if safe else x.astype(object)).sum(axis=0).astype(object)


def _products(y: np.ndarray) -> np.ndarray:
    """y'y as exact integers: stretches of rows whose sums are exact as doubles, else Python's integers."""
    square = greatest(y) ** 2
    rows = EXACT // square if square else len(y)
    if rows == 0:
        wide = y.astype(object)
        return wide.T @ wide
    total = np.zeros((y.shape[1],) * 2, dtype=object)
    for a in range(0, len(y), max(1, min(rows, len(y)))):
        part = y[a : a + rows].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64)
    return total


def _cell_sums(points: DataFrame, cells: Callable[[int, np.ndarray], np.ndarray], kind: str) -> dict[int, dict[tuple[int, int], object]]:
    """By width, the sums over all points of a matrix that ``cells`` makes of a part of them.

    A task sends one row per cell; the driver gets one row per width and cell.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, x in matrices(batch):
                part = cells(width, x)
                totals[width] = totals[width] + part if width in totals else part
        for width, total in totals.items():
            i, j = np.indices(total.shape).reshape(2, -1)
            columns = [pa.array(np.full(i.size, width, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                       pa.array([repr(float(v)) if kind == "double" else str(v) for v in total.reshape(-1)], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["width", "i", "j", "v"])

    rows = points.mapInArrow(summed, "width int, i int, j int, v string")
    merged = rows.groupBy("width", "i", "j").agg(F.sum(F.col("v").cast(kind)).alias("v")).collect()
    found: dict[int, dict[tuple[int, int], object]] = {}
    for r in merged:
        found.setdefault(r["width"], {})[r["i"], r["j"]] = float(r["v"]) if kind == "double" else int(r["v"])
    return found


def fit(points: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """By width, the whitening of (width, x), each row of which counts once."""
    widths = [r["width"] for r in points.select("width").distinct().limit(MOST_WIDTHS + 1).collect()]
    if len(widths) > MOST_WIDTHS or any(w > MOST_WIDTH for w in widths):
        raise ValueError(f"more than {MOST_WIDTHS} widths of vectors, or one above {MOST_WIDTH}")
    # The last cell of a row of sums holds the number of vectors.
    sums = _cell_sums(points, lambda _, x: np.append(_column_sums(x), len(x))[None, :].astype(object), "decimal(38,0)")
    totals = {w: [cells[0, j] for j in range(w + 1)] for w, cells in sums.items()}
    # The integer nearest to the mean of each dimension.
    near = {w: np.array([(2 * s + t[-1]) // (2 * t[-1]) for s in t[:-1]], dtype=np.int64) for w, t in totals.items()}
    products = _cell_sums(points, lambda w, x: _products(x - near[w]), "decimal(38,0)")
    models = {}
    for width, (*s, n) in totals.items():
        rest = [a - n * int(r) for a, r in zip(s, near[width], strict=True)]
        cells = products.get(width, {})
        # n^2 times the covariance is an integer; the division rounds once.
        v = np.array([[(n * cells[i, j] - rest[i] * rest[j]) / (n * n) for j in range(width)] for i in range(width)])
        v = v.reshape(width, width)
        values, axes = leading(v, components)
        models[width] = Whitening(n, tuple(s), values, axes, float(np.trace(v)))
    return models


def identity_errors(points: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """By width, the greatest entry of |covariance of the whitened points - I|, measured on all points."""
    shared = points.sparkSession.sparkContext.broadcast(models)

    def moments(width: int, x: np.ndarray) -> np.ndarray:
        z = shared.value[width].project(x)
        return np.vstack([z.T @ z, z.sum(axis=0)[None, :]])

    found = _cell_sums(points, moments, "double")
    errors = {}
    for width, model in models.items():
        k, cells = len(model.values), found.get(width, {})
        if k == 0:
            errors[width] = 0.0
            continue
        both = np.array([[cells[i, j] for j in range(k)] for i in range(k)]) / model.n
        mean = np.array([cells[k, j] for j in range(k)]) / model.n
        errors[width] = float(np.abs(both - np.outer(mean, mean) - np.eye(k)).max())
    return errors


def whiten(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    components: int = COMPONENTS, scale: int = SCALE,
) -> DataFrame:
    """(_id, n, deviation, whitened, explained, identity_error): one row per usable vector.

    ``whitened`` and ``explained`` are arrays with one entry per component, by falling eigenvalue.
    Null vectors and vectors with null or non-finite entries give no row. Copies count once in the fit
    and give a row each; a null or repeated id is kept as it is. Vectors of another width are fitted
    and whitened among themselves. Components without variance (to working precision) are left out,
    so that one distinct vector, or empty ones, give empty arrays. An empty table gives an empty one.
    A deviation or entry beyond 64 bits is an error. Other columns are not read.
    """
    rows = written(integer_vectors(df, id_col, vector_col, scale), "whiten-rows")
    points = written(rows.select("width", "x").distinct(), "whiten-points")
    models = fit(points, components)
    shared = df.sparkSession.sparkContext.broadcast((models, identity_errors(points, models)))

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, errors = shared.value
        for batch in batches:
            for width, at, x in matrices(batch):
                model = models[width]
                k, size = len(model.values), len(at)
                ends = pa.array((np.arange(size + 1) * k).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.reshape(-1))) for v in (
                    model.project(x), np.tile(model.values / model.trace if k else model.values, (size, 1)))]
                yield pa.RecordBatch.from_arrays(
                    [batch["_id"].take(pa.array(at)), pa.array(np.full(size, model.n, np.int64)), pa.array(model.deviations(x)),
                     *lists, pa.array(np.full(size, errors[width]))],
                    names=["_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(
        applied, "_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")


def query(embeddings: DataFrame) -> DataFrame:
    rows = whiten(embeddings).select(
        F.col("_id").alias("vec_id"), "n", "deviation", "identity_error",
        F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "both"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
                       F.col("both.whitened").alias("whitened"), F.col("both.explained").alias("explained"), "identity_error")
