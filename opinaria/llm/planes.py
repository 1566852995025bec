"""Bit-plane shuffling: a block of integers is transposed into planes, each compressed with zstandard."""

from __future__ import annotations

import numpy as np
import zstandard

LEVEL = 3
BYTES, BITS = "byte", "bit"
_packers: dict[int, zstandard.ZstdCompressor] = {}


def _packer(level: int) -> zstandard.ZstdCompressor:
    if level not in _packers:
        _packers[level] = zstandard.ZstdCompressor(level=level)
    return _packers[level]


def pack(values: np.ndarray, kind: str = BYTES, level: int = LEVEL) -> list[bytes]:
    """The planes of an unsigned array: plane i has byte (or bit) i of every value, lowest first."""
    width = values.dtype.itemsize
    columns = np.ascontiguousarray(values, dtype=values.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, width).T
    if kind == BITS:
        columns = [np.packbits((c >> i) & 1, bitorder="little") for c in columns for i in range(8)]
    return [_packer(level).compress(c.tobytes()) for c in columns]


def unpack(planes: list[bytes], size: int, kind: str = BYTES) -> np.ndarray:
    """The array that ``pack`` was given; ``size`` values of 4 or 8 bytes."""
    unpacker = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(unpacker.decompress(p), dtype=np.uint8) for p in planes]
    if kind == BITS:
        bits = [np.unpackbits(r, bitorder="little", count=size) for r in rows]
        rows = [sum(bits[a + i] << np.uint8(i) for i in range(8)) for a in range(0, len(bits), 8)]
    out = np.empty((size, len(rows)), dtype=np.uint8)
    for i, row in enumerate(rows):
        out[:, i] = row
    return out.view(f"<u{len(rows)}").ravel()
