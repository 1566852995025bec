"""Token ids in binary files: fixed-size blocks of ids in byte or bit planes, with a chunk index.

A file set is a Parquet folder below the shared scratch folder; every row is one chunk of whole
documents in ascending id order, its blocks of ids (``BLOCK`` each, the last one shorter) as
zstandard-compressed planes, and its index: shard, place in the shard, ids and lengths of its
documents. Spark's writer commits it, so lost tasks leave no half-written chunk behind.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator, Sequence
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinaria.llm import arrays as A
from opinaria.llm import planes as P
from opinaria.sources.scratch import new_path

BLOCK, CHUNK, END = 65_536, 1_000_000, 2
# Distinct pieces between spaces whose ids a worker remembers at most; beyond it, it starts anew from its last texts' pieces.
REMEMBERED = 700_000
CHUNKS = (
    "shard int, chunk int, start_in_shard long, n_ids long, kind string, doc_ids array<long>, "
    "lengths array<long>, blocks array<struct<n:int,planes:array<binary>>>"
)
# Fixed value: the published split of this byte-level vocabulary.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_MARKS = frozenset(".,;:!?)")
# White space to one library and not to the other: such texts are asked for whole.
_ODD = r"[\x{1c}-\x{1f}\x{85}\x{180e}\x{200b}\x{feff}]"
_INNER = re.compile(r"(?<=\S) (?=\S)")
_SPACE = r"[\s\v\p{Z}]"
_DOUBLE = f"{_SPACE}{_SPACE}|^{_SPACE}|{_SPACE}$"
# Characters whose kind no version of Unicode changes: the library splits words of them as the pattern above does.
_SETTLED = re.compile("[\\0-\u024f\u0400-\u0481\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")
# Stand for two bytes that UTF-8 never has.
PIECE_END, WORD_END = "\udcff", "\udcfe"
ASKED_AT_ONCE = 64
KEPT = "token files"
_encoders: dict[str, PieceEncoder] = A.kept(KEPT)


def split_piece(piece: str) -> Sequence[str]:
    """The words of a piece; the usual ones, letters behind a space and one mark at most, need no pattern."""
    if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
        return (piece,)
    if piece[-1:] in _MARKS and piece[1:-1].isalpha() and (piece[0] == " " or piece[0].isalpha()):
        return piece[:-1], piece[-1]
    return _WORDS.findall(piece)


def byte_letters() -> dict[int, str]:
    """Fixed value: the published letter of each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {b: chr(hidden.get(b, b)) for b in range(256)}


_LETTERS = byte_letters()
_ID = attrgetter("id")


class PieceEncoder:
    """Ids of texts by the tokenizers library, asked once for each distinct word of its byte-level split.

    No token crosses a single space between two other characters to the left, nor the borders of
    the split below, so a text's ids are those of its words one after another. Where the library is
    sure to split alike, its model gets the words split already, many pieces in one call; the whole
    library is asked for others.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.known: dict[str, bytes] = {}
        (self.line_break,) = np.frombuffer(self.ids("\n"), dtype="<u4").tolist()
        # Letters of bytes that UTF-8 never has are in no other token, so that the model merges nothing across them.
        self.ends = [self.tokenizer.token_to_id(_LETTERS[e.encode("utf-8", "surrogateescape")[0]]) for e in (PIECE_END, WORD_END)]
        alone = None not in self.ends and not any(
            len(t) > 1 and not {_LETTERS[254], _LETTERS[255]}.isdisjoint(t) for t in self.tokenizer.get_vocab(with_added_tokens=False))
        self.model = self.tokenizer.model if alone and self.tokenizer.normalizer is None else None

    def ids(self, text: str) -> bytes:
        (made,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(made.ids, dtype="<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Ask the whole library for words; all but white space go in one text, a line break after each."""
        plain = [w for w in words if not w.isspace()]
        for a in range(0, len(plain), 2_000):
            part = plain[a : a + 2_000]
            self.keep(part, self.ids("".join([f"{w}\n" for w in part])), self.line_break)
        for word in words:
            if word not in self.known:
                self.known[word] = self.ids(word)

    def learn_settled(self, pieces: list[str]) -> None:
        """Ask the model for pieces of settled characters, many at once, with an end behind each and one between words."""
        ids, ask, piece_end, word_end = array("I"), self.model.tokenize, *self.ends
        for a in range(0, len(pieces), ASKED_AT_ONCE):
            text = "".join([f"{WORD_END.join(split_piece(p))}{PIECE_END}" for p in pieces[a : a + ASKED_AT_ONCE]])
            ids.extend(map(_ID, ask(text.encode("utf-8", "surrogateescape").decode("latin-1").translate(_LETTERS))))
        got = np.array(ids, dtype="<u4")
        self.keep(pieces, got[got != word_end].tobytes(), piece_end)

    def keep(self, asked: list[str], got: bytes, end: int) -> None:
        """Remember the ids between the ends, if there are as many ends as were asked."""
        cuts = 4 * np.flatnonzero(np.frombuffer(got, dtype="<u4") == end)
        if len(cuts) == len(asked) > 0:
            begins = [0, *(cuts[:-1] + 4).tolist()]
            self.known.update({w: got[x:y] for w, x, y in zip(asked, begins, cuts.tolist(), strict=True)})

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each with the space before it if it has one; a word is a piece of one word."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = list(dict.fromkeys([p for p, ids in zip(pieces, map(known.get, pieces), strict=True) if ids is None]))
        if self.model is not None:
            self.learn_settled([p for p in new if p and (p.isascii() or _SETTLED.fullmatch(p))])
        split = {p: split_piece(p) for p in new if p not in known}
        self.learn({w for parts in split.values() for w in parts if w not in known})
        known.update({piece: b"".join([known[w] for w in parts]) for piece, parts in split.items()})
        return [known[p] for p in pieces]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text as little-endian bytes."""
        rows = texts.to_pylist()
        asked_whole = pc.match_substring_regex(texts, _ODD)
        for special in self.special:
            asked_whole = pc.or_(asked_whole, pc.match_substring(texts, special))
        direct = {i for i, whole in enumerate(asked_whole.to_pylist()) if whole}
        odd = [i for i, x in enumerate(pc.match_substring_regex(texts, _DOUBLE).to_pylist()) if x and i not in direct]
        out: list[bytes] = [self.ids(t) if i in direct else b"" for i, t in enumerate(rows)]
        for i in odd:
            first, *later = _INNER.split(rows[i])
            out[i] = b"".join(self.pieces([first, *(f" {p}" for p in later)]))
        skip = {*direct, *odd}
        plain = [i for i in range(len(rows)) if i not in skip and rows[i]]
        lists = pc.split_pattern(pa.array([rows[i] for i in plain], pa.string()), " ")
        offsets = np.asarray(lists.offsets).astype(np.int64)
        offsets -= offsets[0]
        if not plain:
            return out
        coded = lists.flatten().dictionary_encode()
        names = pc.binary_join_element_wise("", coded.dictionary, " ").to_pylist()
        firsts = self.pieces([rows[i].split(" ", 1)[0] for i in plain])
        known = self.pieces(names)
        if len(self.known) > REMEMBERED:
            self.known = dict(zip(names, known, strict=True))
        # All ids lie one after another in the taken array; a text's own are behind its first piece's.
        taken = pa.array(known, pa.large_binary()).take(coded.indices)
        _, at, data = taken.buffers()
        ends = np.frombuffer(at, dtype=np.int64, count=len(taken) + 1)
        begins, cuts = ends[offsets[:-1] + 1].tolist(), ends[offsets[1:]].tolist()
        data = memoryview(data) if data is not None else b""
        for i, first, a, b in zip(plain, firsts, begins, cuts, strict=True):
            out[i] = b"".join((first, data[a:b]))
        return out


def encoder(path: str) -> PieceEncoder:
    """One per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def chunk_batch(number: int, start: int, ids: list, rows: list[bytes], kind: str) -> pa.RecordBatch:
    values = np.frombuffer(b"".join(rows), dtype="<u4")
    blocks = [values[a : a + BLOCK] for a in range(0, len(values), BLOCK)]
    made = {
        "shard": TaskContext.get().partitionId(), "chunk": number, "start_in_shard": start, "n_ids": len(values),
        "kind": kind, "doc_ids": ids, "lengths": [len(r) // 4 for r in rows],
        "blocks": [{"n": len(b), "planes": P.pack(b, kind)} for b in blocks],
    }
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()),
             pa.list_(pa.struct([("n", pa.int32()), ("planes", pa.list_(pa.binary()))]))]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made.values(), kinds, strict=True)], list(made))


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = END, kind: str = P.BYTES) -> None:
    """Encode all texts and write them to ``path`` in ascending order of the ids (nulls first).

    A null text is an empty one and has the end id alone; rows of one id stay in any order beside
    each other; an empty table writes an empty folder that can be read.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number, start = encoder(tokenizer), 0, 0
        ids, rows, size = [], [], 0
        for whole in batches:
            for batch in A.slices(whole, "_text", 8 * A.SLICE_BYTES):
                found = coder.encode(pc.fill_null(batch["_text"], ""))
                for doc, row in zip(batch["_id"].to_pylist(), found, strict=True):
                    ids.append(doc)
                    rows.append(row + end)
                    size += len(row) // 4 + 1
                    if size >= CHUNK:
                        yield chunk_batch(number, start, ids, rows, kind)
                        number, start = number + 1, start + size
                        ids, rows, size = [], [], 0
        if ids:
            yield chunk_batch(number, start, ids, rows, kind)

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    ordered = rows.repartitionByRange("_id").sortWithinPartitions("_id")
    ordered.mapInArrow(A.tidy(encoded, KEPT), CHUNKS).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary): every document of a file set, from its blocks."""
    chunks = spark.read.schema(CHUNKS).parquet(path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, start, kind, ids, lengths = (
                    batch[c][row].as_py() for c in ("shard", "start_in_shard", "kind", "doc_ids", "lengths"))
                blocks = batch["blocks"][row].as_py()
                data = b"".join(P.unpack(b["planes"], b["n"], kind).tobytes() for b in blocks)
                ends = np.cumsum(np.array(lengths, dtype=np.int64))
                begins = ends - np.array(lengths, dtype=np.int64)
                cut = [data[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(begins + start),
                    pa.array(np.array(lengths, dtype=np.int64)), pa.array(cut, pa.binary()),
                ], names=["shard", "doc_id", "at", "n_tokens", "ids"])

    docs = chunks.mapInArrow(decoded, "shard int, doc_id long, at long, n_tokens long, ids binary")
    # One row per task that wrote: their number is the bound of this table and of the window over it.
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = docs.join(F.broadcast(offsets), "shard")
    return placed.select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids")


def query(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    write(docs, path, tokenizer)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
