"""Language-model scoring by deleted interpolation of bigrams, unigrams and a uniform share.

The model is p(w | v) = a * c(v, w) / c(v) + b * c(w) / N + c / (V + 1); the weights a, b, c depend on
how often the context v was seen and are learned by expectation-maximisation on counts held out from
the training part. Counts cover the whole corpus and stay distributed:

* Documents are gathered in slices of about 6 MB, written once. A slice sends each distinct key
  (word or pair) with its count to the part of the key space that the key's hash names, as one packed
  row per part that it has keys of. So no key, however frequent, sends more than one entry per slice,
  and a slice sends at most one row per key of its own, however many parts there are.
* Each part adds up its keys and sends every slice the totals of the keys it asked for.
* A slice with its totals scores its documents by itself.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinaria.llm import arrays as A
from opinaria.llm import planes as P
from opinaria.llm.steps import written

SLICE = 6_000_000
KEYS_PER_PART = 2_000_000
# Slices are written once and dealt again with their totals; a higher level costs little beside the counting.
SLICE_LEVEL = 5
# Fewer values than this are sent as they are: frames of planes would be longer and dearer than they.
LEAST_PLANES = 64
# What a document is for: its counts, or weights (held out from the counts at first), or neither.
COUNTED, WEIGHED, HELD_OUT = 0, 1, 2
END, START = np.uint64(0x1F3D5B79A2C4E6F8), np.uint64(0x8E6C4A2917395B7D)
# Probabilities are rounded to quarter octaves where weights are learned, which bounds that table.
STEPS, LOWEST, ROUNDS = 4, -160, 60
BUCKETS = 40


def slices(docs: DataFrame) -> DataFrame:
    """(slice, kind, n_bytes, payload): documents of one kind, about SLICE bytes of text, as Arrow rows."""
    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[pa.RecordBatch]] = {}
        sizes: dict[int, int] = {}

        def made(kind: int) -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting.pop(kind)).combine_chunks()
            sink, options = pa.BufferOutputStream(), pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", SLICE_LEVEL))
            with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                out.write_table(table)
            row = [uuid.uuid4().int >> 65], [kind], [sizes.pop(kind)], [sink.getvalue().to_pybytes()]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)],
                                              names=["slice", "kind", "n_bytes", "payload"])

        for whole in batches:
            for batch in A.slices(whole, "_text"):
                for kind in (COUNTED, WEIGHED, HELD_OUT):
                    part = batch.filter(pc.equal(batch["_kind"], kind))
                    if part.num_rows:
                        text = pc.ascii_lower(pc.fill_null(part["_text"], ""))
                        waiting.setdefault(kind, []).append(
                            pa.RecordBatch.from_arrays([part["_id"], text], names=["_id", "_text"]))
                        sizes[kind] = sizes.get(kind, 0) + text.nbytes
                        if sizes[kind] >= SLICE:
                            yield made(kind)
        for kind in list(waiting):
            yield made(kind)

    return docs.mapInArrow(gathered, "slice long, kind int, n_bytes long, payload binary")


class Tokens:
    """The tokens of a slice: words, then one end per document; keys of words and of pairs."""

    def __init__(self, payload: bytes):
        table = pa.ipc.open_stream(payload).read_all().combine_chunks()
        self.ids = table["_id"].combine_chunks()
        texts = table["_text"].combine_chunks()
        words, lengths = A.text_words(texts)
        self.lengths = lengths + 1
        ends = np.cumsum(self.lengths) - 1
        word = np.empty(int(self.lengths.sum()), dtype=np.uint64)
        is_end = np.zeros(len(word), dtype=bool)
        is_end[ends] = True
        word[is_end] = END
        word[~is_end] = A.hash_words(words)
        before = np.concatenate([[START], word[:-1]]).astype(np.uint64)
        before[np.concatenate([[0], ends[:-1] + 1])] = START
        self.words, self.word_at = np.unique(A.mix(word), return_inverse=True)
        # The start stands once before each document, as the end once behind it: they share a count.
        context = np.where(before == START, END, before)
        self.context_at = np.searchsorted(self.words, A.mix(context))
        self.pairs, self.pair_at = np.unique(A.mix(before * np.uint64(0x9E3779B97F4A7C15) + word), return_inverse=True)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key: equal stretches of the key space, in the order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def pack_counts(values: np.ndarray) -> list[bytes]:
    """Counts and totals as planes of the narrowest integers that hold them, 64 bits at most."""
    return P.pack(values.astype(np.min_scalar_type(int(values.max(initial=0)))), level=1)


def unpack_counts(packed: list[bytes] | None) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.int64)
    # Every value has as many bytes as there are planes, so the first plane gives the number.
    size = len(P.zstandard.ZstdDecompressor().decompress(packed[0]))
    return P.unpack(packed, size).astype(np.int64)


def pack_keys(keys: np.ndarray) -> list[bytes]:
    """Sorted keys as differences in planes; a few keys as one string of the same differences."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return P.pack(steps, level=1) if len(steps) >= LEAST_PLANES else [steps.tobytes()]


def unpack_keys(packed: list[bytes] | None, size: int) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.uint64)
    steps = np.frombuffer(packed[0], dtype="<u8") if len(packed) == 1 else P.unpack(packed, size)
    return np.cumsum(steps, dtype=np.uint64)


PACKET = "part int, slice long, kind int, n1 int, keys1 array<binary>, c1 array<binary>, n2 int, keys2 array<binary>, c2 array<binary>"
PLANES = pa.list_(pa.binary())


def packets(made: DataFrame, parts: int) -> DataFrame:
    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, kind = batch["slice"][row].as_py(), batch["kind"][row].as_py()
                tokens = Tokens(batch["payload"][row].as_py())
                counts = [np.bincount(tokens.word_at, minlength=len(tokens.words)),
                          np.bincount(tokens.pair_at, minlength=len(tokens.pairs))]
                keys = [tokens.words, tokens.pairs]
                cuts = [np.searchsorted(part_of(k, parts), np.arange(parts + 1)) for k in keys]
                own = np.unique(np.concatenate([part_of(k, parts) for k in keys]))
                for part in own.tolist():
                    line: list = [part, name, kind]
                    for k, c, cut in zip(keys, counts, cuts, strict=True):
                        a, b = cut[part], cut[part + 1]
                        line += [int(b - a), pack_keys(k[a:b]), pack_counts(c[a:b])]
                    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), PLANES, PLANES, pa.int32(), PLANES, PLANES)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], k) for v, k in zip(line, kinds, strict=True)],
                        names=["part", "slice", "kind", "n1", "keys1", "c1", "n2", "keys2", "c2"])

    return made.select("slice", "kind", "payload").mapInArrow(sent, PACKET)


TOTALS = "part int, slice long, kind int, counted1 array<binary>, weighed1 array<binary>, counted2 array<binary>, weighed2 array<binary>, stats array<long>"
# The totals that slices are sent: weights are learned with the first two alone.
COUNTS = ("counted1", "counted2", "weighed1", "weighed2")


def add_up(table: pa.Table) -> pa.Table:
    """One part: totals of its keys for each slice that sent them; a row without a slice has the sums."""
    kinds = np.asarray(table["kind"])
    out: list[list] = [[], [], [], []]
    stats: list[int] = []
    for level, (n, keys, counts) in enumerate((("n1", "keys1", "c1"), ("n2", "keys2", "c2"))):
        sizes = np.asarray(table[n]).astype(np.int64)
        all_keys = np.concatenate([unpack_keys(k, s) for k, s in zip(table[keys].to_pylist(), sizes.tolist(), strict=True)])
        all_counts = np.concatenate([unpack_counts(c) for c in table[counts].to_pylist()])
        distinct, at = np.unique(all_keys, return_inverse=True)
        kind = np.repeat(kinds, sizes)
        totals = []
        for k in (COUNTED, WEIGHED):
            total = np.zeros(len(distinct), dtype=np.int64)
            np.add.at(total, at[kind == k], all_counts[kind == k])
            totals.append(total)
        ends = np.cumsum(sizes)
        for i, total in enumerate(totals):
            wide = total[at]
            out[2 * level + i] = [pack_counts(wide[b - s : b]) for b, s in zip(ends, sizes, strict=True)]
        if level == 0:
            stats = [int(totals[0].sum()), int(totals[0].sum() + totals[1].sum()), int(((totals[0] + totals[1]) > 0).sum())]
    rows = len(kinds)
    parts = table["part"].to_pylist()
    columns = [pa.array([*parts, parts[0]], pa.int32()), pa.array([*table["slice"].to_pylist(), None], pa.int64()),
               pa.array([*kinds.tolist(), None], pa.int32())]
    columns += [pa.array([*c, None], PLANES) for c in out]
    columns.append(pa.array([*[None] * rows, stats], pa.list_(pa.int64())))
    return pa.Table.from_arrays(columns, names=["part", "slice", "kind", "counted1", "weighed1", "counted2", "weighed2", "stats"])


def with_totals(made: DataFrame, totals: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Slices with the named totals that all parts sent back, in the order of the parts; one row per slice."""
    sent = totals.filter("slice IS NOT NULL").groupBy("slice").agg(F.array_sort(F.collect_list(
        F.struct("part", *names))).alias("sent"))
    return made.join(sent.hint("shuffle_hash"), "slice").select("kind", "payload", "sent")


def token_counts(sent: list[dict], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """For every distinct word and pair of a slice, the named ones of its counts in both training parts."""
    def joined(name: str) -> np.ndarray:
        parts = [unpack_counts(row[name]) for row in sent]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    return {name: joined(name) for name in names}


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Contexts by how often they were seen: 0, 1, 2-3, 4-7 and so on."""
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def held_out_table(joined: DataFrame, n_counted: int) -> DataFrame:
    """(bucket, p2, p1, n): held-out tokens by bucket and rounded probabilities; bounded by its keys."""
    def rounded(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.maximum(np.rint(STEPS * np.log2(np.maximum(p, 1e-300))), LOWEST), LOWEST - 1).astype(np.int64)

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tokens = Tokens(batch["payload"][row].as_py())
                counts = token_counts(batch["sent"][row].as_py(), COUNTS[:2])
                one, two = counts["counted1"], counts["counted2"]
                context = one[tokens.context_at]
                p2 = two[tokens.pair_at] / np.maximum(context, 1)
                p1 = one[tokens.word_at] / max(n_counted, 1)
                keys = (bucket_of(context) * 1000 + (rounded(p2) - LOWEST + 1)) * 1000 + rounded(p1) - LOWEST + 1
                keys, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    return joined.mapInArrow(tabled, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def learn_weights(rows: list[tuple[int, int]], distinct: int) -> np.ndarray:
    """(bucket, 3) weights of pair, word and uniform share, by expectation-maximisation.

    Buckets without held-out tokens take the weights of the nearest smaller one; the lowest starts
    from a third each. A context never seen gives the pair no weight.
    """
    keys = np.array([r[0] for r in rows], dtype=np.int64)
    n = np.array([r[1] for r in rows], dtype=float)
    bucket, p2, p1 = keys // 1_000_000, keys // 1000 % 1000, keys % 1000
    shares = np.stack([np.where(p > 0, 2.0 ** ((p - 1 + LOWEST) / STEPS), 0.0) for p in (p2, p1)]
                      + [np.full(len(keys), 1 / (distinct + 1))], 1).reshape(-1, 3)
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    for b in range(BUCKETS):
        mine = bucket == b
        if not mine.any():
            if b > 1:
                weights[b] = weights[b - 1]
            continue
        w = weights[b]
        for _ in range(ROUNDS):
            mixed = shares[mine] * w
            w = (n[mine, None] * mixed / mixed.sum(1, keepdims=True)).sum(0) / n[mine].sum()
        # No share is quite zero, so that no text is impossible.
        w = (1 - 1e-6) * w + 1e-6 * (np.array([0, 0.5, 0.5]) if b == 0 else 1 / 3)
        weights[b] = w
    return weights


SCORES = "_id long, kind int, n_tokens long, n_known long, base_score double, score double"


def scored(joined: DataFrame, weights: np.ndarray, n_all: int, distinct: int) -> DataFrame:
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tokens = Tokens(batch["payload"][row].as_py())
                counts = token_counts(batch["sent"][row].as_py(), COUNTS)
                one, two = counts["counted1"] + counts["weighed1"], counts["counted2"] + counts["weighed2"]
                word, context = one[tokens.word_at], one[tokens.context_at]
                w = weights[bucket_of(context)]
                p = (w[:, 0] * two[tokens.pair_at] / np.maximum(context, 1)
                     + w[:, 1] * word / max(n_all, 1) + w[:, 2] / (distinct + 1))
                start = A.starts_of(tokens.lengths)
                base = np.log10((word + 1) / (n_all + distinct + 1))
                sums = [np.add.reduceat(x, start) for x in ((word > 0).astype(np.int64), base, np.log10(p))]
                kind = np.full(len(start), batch["kind"][row].as_py(), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [tokens.ids, pa.array(kind), pa.array(tokens.lengths.astype(np.int64)), *map(pa.array, sums)],
                    names=["_id", "kind", "n_tokens", "n_known", "base_score", "score"])

    return joined.mapInArrow(scores, SCORES)


def score_texts(docs: DataFrame, kind: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, kind, n_tokens, n_known, train_tokens, base_score, score) of every text.

    ``kind`` tells what a row is for: 0 counted, 1 counted once the weights are learned on it, 2 scored
    only. Words are lower-cased (A-Z) and end with one end token per text; a null text is its end
    alone. ``score`` is the log10 probability of the text; ``base_score`` that of single words with one
    added to each count. Ids may be null or repeat: every row is scored. Without held-out counts the
    weights are equal; an empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"),
                       kind.cast("int").alias("_kind"))
    made = written(slices(rows), "lm-slices")
    size = made.agg(F.sum("n_bytes")).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # About one distinct word or pair for every eight bytes of text.
    parts = max(least, math.ceil(size / 8 / KEYS_PER_PART))
    totals = written(packets(made, parts).groupBy("part").applyInArrow(add_up, TOTALS), "lm-totals")
    sums = totals.filter("slice IS NULL").select(*(F.sum(F.col("stats")[i]) for i in range(3))).first()
    n_counted, n_all, distinct = (x or 0 for x in sums)
    teaches = F.col("kind") == WEIGHED
    weighed = with_totals(made.filter(teaches), totals.filter(teaches), COUNTS[:2])
    weights = learn_weights([tuple(r) for r in held_out_table(weighed, n_counted).collect()], distinct)
    done = scored(with_totals(made, totals, COUNTS), weights, n_all, distinct)
    return done.withColumn("train_tokens", F.lit(n_all).cast("long"))


def query(docs: DataFrame) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    # Remainder 2 is never learned from, nor is a row without an id; 3 teaches the weights first.
    kind = F.when(remainder == 2, HELD_OUT).when(remainder == 3, WEIGHED).when(remainder.isNull(), HELD_OUT).otherwise(COUNTED)
    done = score_texts(docs, kind)
    return done.select(F.col("_id").alias("doc_id"), (F.col("kind") == HELD_OUT).alias("held_out"), "n_tokens", "n_known",
                       "train_tokens", "base_score", "score")
