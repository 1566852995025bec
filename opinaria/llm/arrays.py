"""Array helpers for functions that run inside Spark tasks: words, rolling hashes, chosen k-mers.

All of them work on slices of bounded size, so that a task's memory does not follow its input.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql.types import StructType

SLICE_BYTES = 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION_BITS = np.uint64(31)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
# What operators keep in a worker process between tasks, by their names.
_kept: dict[str, dict] = {}


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text; one longer text is a part of its own."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch[text]), 0), dtype=np.int64)
    parts = np.cumsum(sizes) // most
    starts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:], strict=False):
        yield batch.slice(a, b - a)


def kept(name: str) -> dict:
    """The table that an operator keeps in this worker process until another one asks for its memory."""
    return _kept.setdefault(name, {})


def give_back(own: str = "") -> None:
    """Return to the system what earlier work of this worker process keeps: tables, Arrow's and C's free memory.

    The table kept under the name ``own`` stays.
    """
    _powers.clear()
    for name, table in _kept.items():
        if name != own:
            table.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], own: str = "") -> Callable:
    """The function of a task; before and behind it a worker keeps no more than the table under the name ``own``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(own)
        try:
            yield from work(batches)
        finally:
            give_back(own)

    return run


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose high bits depend on all bits."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(32)
    return values


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts in one array, and the length of each text; null counts as empty."""
    rows = [x or b"" for x in pc.cast(texts, pa.binary()).to_pylist()]
    lengths = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    return np.frombuffer(b"".join(rows), dtype=np.uint8), lengths


def text_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts, and the number in each; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten()
    filled = np.asarray(pc.greater(pc.binary_length(words), 0))
    before = np.concatenate([[0], np.cumsum(filled)])
    lengths = np.diff(before[np.asarray(lists.offsets) - lists.offsets[0].as_py()])
    return words.filter(pa.array(filled)), lengths


def hash_words(words: pa.Array, seed: int = 42) -> np.ndarray:
    """A 64-bit hash of every word; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    distinct = [xxhash.xxh64_intdigest(w, seed) for w in pc.cast(coded.dictionary, pa.binary()).to_pylist()]
    return np.array(distinct, dtype=np.uint64)[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.uint64)


class Rolling:
    """Hashes of any run of units: one prefix sum, then two lookups for a run."""

    def __init__(self, values: np.ndarray):
        size = 1 << max(16, (len(values) + 1).bit_length())
        if size not in _powers:
            _powers.clear()
            up, down = (np.full(size, b, dtype=np.uint64) for b in (_BASE, _INVERSE))
            up[0] = down[0] = 1
            _powers[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        up, self.down = _powers[size]
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def all_runs(self, length: int) -> np.ndarray:
        """Of the run of ``length`` units at every position."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(sums + (ends - starts).astype(np.uint64))


def choose(rolling: Rolling, lengths: np.ndarray, k: int, window: int) -> dict[str, np.ndarray]:
    """For every window of a text, the k-mer in it with the least hash (of equal ones the leftmost).

    The choice depends on the window's content alone, so equal windows choose equal k-mers at equal
    places. One entry per chosen k-mer: ``doc`` (index of the text), ``at`` (its start), ``lo`` and
    ``hi`` (the first and last window that chose it) as positions in the joined texts, and ``key``.
    """
    n = int(lengths.sum())
    docs = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    if n < window:
        none = np.zeros(0, np.int64)
        return {"doc": none, "at": none, "lo": none, "hi": none, "key": np.zeros(0, np.uint64)}
    keys = rolling.all_runs(k)
    least = ((keys >> _POSITION_BITS) << _POSITION_BITS) | np.arange(len(keys), dtype=np.uint64)
    wide, left = 1, window - k + 1
    while wide * 2 <= left:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if left > wide:
        least = np.minimum(least[: n - window + 1], least[left - wide :][: n - window + 1])
    at = (least & np.uint64((1 << 31) - 1)).astype(np.int64)
    valid = docs[: n - window + 1] == docs[window - 1 :]
    same = np.zeros(len(at) + 1, dtype=bool)
    same[1:-1] = (at[1:] == at[:-1]) & valid[1:] & valid[:-1] & (docs[1 : len(at)] == docs[: len(at) - 1])
    lo = np.flatnonzero(valid & ~same[:-1])
    hi = np.flatnonzero(valid & ~same[1:])
    return {"doc": docs[lo].astype(np.int64), "at": at[lo], "lo": lo, "hi": hi, "key": keys[at[lo]]}


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of the closed ranges one after another, and for each the index of its range."""
    sizes = hi - lo + 1
    owner = np.repeat(np.arange(len(lo)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[owner], owner


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as maximal disjoint ones; touching ranges become one."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > reach[:-1]])
    return lo[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])]


def struct_type(**kinds: str) -> StructType:
    """A row type from names and simple kinds; no session is needed."""
    made = StructType()
    for name, kind in kinds.items():
        made.add(name, kind)
    return made


def struct_rows(rows: list[tuple], kind: StructType) -> pa.StructArray:
    """Tuples as an Arrow array of that row type."""
    arrow = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kind]
    arrays = [pa.array(c, arrow[f.dataType.simpleString()]) for c, f in zip(columns, kind, strict=True)]
    return pa.StructArray.from_arrays(arrays, kind.names)
