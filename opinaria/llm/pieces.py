"""SentencePiece encoding and decoding of merge-type (BPE) models by a prefix table.

For every prefix of a piece run, the table keeps the one last token that its encoding can have: of the
vocabulary entries that an automaton finds ending there, the one which is compatible with the last
token of the prefix before it. Two tokens are compatible if merging their joined text gives back just
the two. The ids are then read from the table backwards. A run is what no token can cross: spaces,
then everything up to the next space; each distinct run is encoded once per worker.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinaria.llm import arrays as A

SPACE = "▁"
# Distinct parts of runs that a worker remembers at most; beyond it, it starts anew.
REMEMBERED = 300_000
_RUNS = re.compile(" +[^ ]+| +$")
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
ENCODED = A.struct_type(n_tokens="long", ids="string", decoded="string")
KEPT = "pieces"
_models: dict[str, PrefixTable] = A.kept(KEPT)


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


def read_model(path: str) -> tuple[list[tuple[str, float, int]], dict[int, bytes | int]]:
    """Pieces (text, score, kind) and the normaliser's fields of a model file."""
    with open(path, "rb") as file:
        message = list(fields(file.read()))
    pieces = []
    for number, value in message:
        if number == 1:
            part = dict(fields(value))
            (score,) = struct.unpack("<f", part.get(2, bytes(4)))
            pieces.append((part[1].decode(), score, part.get(3, NORMAL)))
    normaliser = next((dict(fields(v)) for n, v in message if n == 3), {})
    return pieces, normaliser


class PrefixTable:
    """Encoder and decoder of one model: identity normalisation, a space put before each text."""

    def __init__(self, path: str):
        self.pieces, normaliser = read_model(path)
        plain = not normaliser.get(2) and normaliser.get(3, 1) and not normaliser.get(4, 1) and normaliser.get(5, 1)
        crossing = any(SPACE in p.lstrip(SPACE) for p, _, kind in self.pieces if kind == NORMAL)
        if not plain or crossing or any(kind == USER for _, _, kind in self.pieces):
            raise ValueError("a model with identity normalisation and no pieces across words is asked for")
        self.rank = {p: (-score, i) for i, (p, score, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)
        self.lone = {c for p in self.rank for c in p} - set(self.rank)
        self.automaton = ahocorasick.Automaton()
        # Only tokens that their own merging gives back can stand in an encoding.
        for piece in self.rank:
            if len(piece) == 1 or self.merged(piece) == [piece]:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        # Where two neighbouring characters stand side by side in no piece, no token crosses.
        self.inside = {pair for p in self.rank for pair in zip(p, p[1:], strict=False)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, str, str]] = {}

    def forget(self) -> None:
        """Drop what texts have left; the model's own tables stay."""
        self.known, self.pairs = {}, {}

    def merged(self, text: str) -> list[str]:
        """Merging by rank, leftmost first among equals: the definition which the table rests on."""
        parts: list[str | None] = list(text)
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        heap = [(self.rank[a + b][0], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
                if a + b in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else -1
            if j < 0 or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and parts[x] + parts[y] in self.rank:
                    both = parts[x] + parts[y]
                    heapq.heappush(heap, (self.rank[both][0], x, both))
        return [p for p in parts if p is not None]

    def compatible(self, a: str, b: str) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > 2 * REMEMBERED:
                self.pairs.clear()
            got = self.pairs[(a, b)] = self.merged(a + b) == [a, b]
        return got

    def tokens(self, run: str) -> list[str]:
        """The tokens of a run; characters that no piece has stand alone."""
        last: list[str | None] = [None] * len(run)
        pairs, compatible = self.pairs, self.compatible
        done = -1
        for end, piece in self.automaton.iter(run):
            # At each end the longest match comes first.
            while done < end - 1:
                done += 1
                if last[done] is None:
                    last[done] = run[done]
            if last[end] is None:
                start = end - len(piece)
                if start < 0:
                    last[end] = piece
                else:
                    previous = last[start]
                    ok = pairs.get((previous, piece))
                    if ok is None:
                        ok = compatible(previous, piece)
                    if ok:
                        last[end] = piece
        out = []
        at = len(run) - 1
        while at >= 0:
            token = last[at] or run[at]
            out.append(token)
            at -= len(token)
        out.reverse()
        return out

    def run_ids(self, run: str) -> list[int]:
        out = []
        for token in self.tokens(run):
            if token in self.rank:
                out.append(self.rank[token][1])
            elif self.bytes:
                out += [self.bytes[b] for b in token.encode()]
            else:
                out.append(self.unknown)
        return out

    def text_of(self, ids: list[int]) -> str:
        """Pieces joined; neighbouring byte pieces are read as UTF-8, bad bytes one by one as U+FFFD."""
        out, raw = [], bytearray()
        for i in [*ids, -1]:
            piece, _, kind = self.pieces[i] if i >= 0 else ("", 0, NORMAL)
            if kind == BYTE:
                raw.append(int(piece[3:5], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append("" if kind == CONTROL else " ⁇ " if kind == UNKNOWN else piece.replace(SPACE, " "))
        return "".join(out)

    def part(self, run: str) -> tuple[int, str, str]:
        got = self.known.get(run)
        if got is None:
            ids = self.run_ids(run)
            back = self.text_of(ids)
            got = len(ids), ",".join(map(str, ids)), back
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[run] = got
        return got

    def run(self, run: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas and the decoded text of one run."""
        inside, start, parts = self.inside, 0, []
        for i, pair in enumerate(zip(run, run[1:], strict=False), 1):
            if pair not in inside:
                parts.append(self.part(run[start:i]))
                start = i
        last = self.part(run[start:])
        if not parts:
            return last
        parts.append(last)
        return sum([p[0] for p in parts]), ",".join([p[1] for p in parts]), "".join([p[2] for p in parts])

    def encode(self, texts: pa.Array) -> list[tuple[int, str, str]]:
        """Of every text: number of ids, the ids joined by commas, and the text they decode to."""
        rows = [t.replace(SPACE, " ") if SPACE in t else t for t in texts.to_pylist()]
        odd = [bool(t) and ("  " in t or t[0] == " " or t[-1] == " ") for t in rows]
        out = [(0, "", "")] * len(rows)
        for i, text in enumerate(rows):
            if odd[i]:
                got = [self.run(r.replace(" ", SPACE)) for r in _RUNS.findall(" " + text)]
                out[i] = sum([g[0] for g in got]), ",".join([g[1] for g in got]), "".join([g[2] for g in got])[1:]
        plain = [i for i, t in enumerate(rows) if t and not odd[i]]
        if not plain:
            return out
        lists = pc.split_pattern(pa.array([rows[i] for i in plain], pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        runs = [self.run(SPACE + w) for w in coded.dictionary.to_pylist()]
        offsets = np.asarray(lists.offsets)
        sizes = np.fromiter((r[0] for r in runs), np.int64, len(runs))[np.asarray(coded.indices)]
        counts = np.add.reduceat(sizes, offsets[:-1])

        def joined(field: int, by: str) -> list[str]:
            words = pa.array([r[field] for r in runs], pa.string()).take(coded.indices)
            offsets_ = pa.array((offsets - offsets[0]).astype(np.int32))
            return pc.binary_join(pa.ListArray.from_arrays(offsets_, words), by).to_pylist()

        for i, n, ids, back in zip(plain, counts.tolist(), joined(1, ","), joined(2, ""), strict=True):
            out[i] = n, ids, back[1:]
        return out


def model(path: str) -> PrefixTable:
    """One per worker process and model file."""
    if path not in _models:
        _models[path] = PrefixTable(path)
    return _models[path]


def encoded(path: str):
    """An Arrow UDF: text -> struct(n_tokens, ids joined by commas, decoded); null counts as empty."""

    @F.arrow_udf(ENCODED)
    def encode(texts: pa.Array) -> pa.Array:
        table = model(path)
        return A.struct_rows(table.encode(pc.fill_null(texts, "")), ENCODED)

    return encode


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, n_tokens, ids_sha256, decoded_sha256): the strings are digested where they are made."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model(path)
        for batch in (part for whole in batches for part in A.slices(whole, "_text", 4 * A.SLICE_BYTES)):
            n, ids, back = [], [], []
            for size, joined, decoded_text in table.encode(pc.fill_null(batch["_text"], "")):
                n.append(size)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(decoded_text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        table.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(A.tidy(hashed, KEPT), "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(docs: DataFrame, path: str) -> DataFrame:
    return digests(docs, path).withColumnRenamed("_id", "doc_id")
