"""Vectors as exact integers: floor(scale * entry) per entry, packed into one binary value per row.

Null vectors and vectors with null or non-finite entries are left out. A packed vector holds 16-bit
integers where all of its entries fit, else 64-bit ones, so equal vectors of one width have equal
bytes. Vectors of different widths live side by side and are never mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
# Integers up to here are exact as doubles.
EXACT = 1 << 53


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    floors = np.floor(values.astype(np.float64) * scale)
    if len(floors) and np.abs(floors).max() >= 2.0**63:
        raise OverflowError("an entry of a vector does not fit into 64 bits")
    return floors.astype(np.int64)


def _packed(matrix: np.ndarray, kind: str) -> pa.Array:
    wide = np.ascontiguousarray(matrix, dtype=kind)
    size = wide.shape[1] * wide.itemsize
    fixed = pa.Array.from_buffers(pa.binary(size), len(wide), [None, pa.py_buffer(wide.tobytes())])
    return fixed.cast(pa.binary())


def _rows(ids: pa.Array, lists: pa.Array, scale: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of one batch, one batch for each width and kind."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    values = pc.cast(pc.list_flatten(lists), pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[~np.isfinite(values)], minlength=len(lengths))
    good = np.asarray(pc.is_valid(lists)) & (bad == 0)
    starts = np.cumsum(lengths) - lengths
    for width in np.unique(lengths[good]).tolist():
        at = np.flatnonzero(good & (lengths == width))
        if width == 0:
            parts = [(at, pa.array([b""] * len(at), pa.binary()))]
        else:
            matrix = _integers(values[starts[at][:, None] + np.arange(width)], scale)
            small = (matrix >= -(1 << 15)).all(axis=1) & (matrix < 1 << 15).all(axis=1)
            parts = [(at[chosen], _packed(matrix[chosen], kind)) for chosen, kind in ((small, "<i2"), (~small, "<i8"))]
        for rows, x in parts:
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array(np.full(len(rows), width, np.int32)), x], names=["_id", "width", "x"])


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(_id long, width int, x binary) of every usable vector; the columns may have any other names beside them."""
    kind = df.schema[vector_col].dataType.simpleString()
    vector = F.col(f"`{vector_col}`")
    if kind not in ("array<float>", "array<double>"):
        vector = vector.cast("array<double>")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _rows(batch["_id"], batch["_v"], scale)

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), vector.alias("_v"))
    return rows.mapInArrow(packed, "_id long, width int, x binary")


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places in the batch, matrix of 64-bit integers) for each width and kind in a packed batch."""
    widths = np.asarray(batch["width"]).astype(np.int64)
    sizes = np.asarray(pc.binary_length(batch["x"])).astype(np.int64)
    for width, size in sorted(set(zip(widths.tolist(), sizes.tolist(), strict=True))):
        at = np.flatnonzero((widths == width) & (sizes == size))
        data = b"".join(batch["x"].take(pa.array(at)).to_pylist())
        kind = "<i2" if size == 2 * width else "<i8"
        yield width, at, np.frombuffer(data, dtype=kind).astype(np.int64).reshape(len(at), width)


def greatest(matrix: np.ndarray) -> int:
    """The greatest absolute value, as a Python integer."""
    return max(abs(int(matrix.max())), abs(int(matrix.min()))) if matrix.size else 0
