"""Phrase mining by partitions (SON): locally frequent phrases of every shard, then an exact global count.

Documents are hashed to shards of equal expected size. A phrase that occurs ``support`` times must occur
``support / shards`` times in one of them at least, whatever the shards' true sizes. Each shard is mined
completely and level by level by a distributed count: a phrase of j words is counted only where both of
its parts of j - 1 words are locally frequent. The union of all shards is then counted over all texts.

Until that last count phrases are 64-bit hashes, and what is frequent is a bitmap of fixed size. Hashes
that meet and bits that are shared only add candidates; the last count is by the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinaria.llm import arrays as A
from opinaria.llm.steps import written

# The bytes that end a piece.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
SHARDS, SLICE_BYTES, BATCH = 3, 4_000_000, 100_000
# Bits of the bitmap; a driver and a task hold an eighth as many bytes.
FILTER_BITS = 26
_FOLD = bytes(ord(".") if c in BREAKS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Mining:
    """Phrases of ``least`` to ``most`` words that occur ``support`` times in their language.

    One is dropped if a longer one around it occurs at least ``part_of_100`` hundredths as often.
    """

    least: int = 2
    most: int = 3
    support: int = 10
    part_of_100: int = 50
    top: int = 2000
    shards: int = SHARDS
    filter_bits: int = FILTER_BITS

    @property
    def local_support(self) -> int:
        return -(-self.support // self.shards)


@dataclass
class Words:
    """The words of a slice as codes into its dictionary, whose hashes are ``hashes``.

    For each word, ``group`` names its text's group and ``room`` the words left in its piece.
    """

    dictionary: pa.Array
    hashes: np.ndarray
    codes: np.ndarray
    group: np.ndarray
    room: np.ndarray

    def runs(self, length: int) -> np.ndarray:
        """Where a run of that many words starts that stays in its piece."""
        return np.flatnonzero(self.room >= length)

    def run_hashes(self, starts: np.ndarray, length: int) -> np.ndarray:
        found = self.hashes[self.codes[starts]]
        for j in range(1, length):
            found = A.mix(found * _STEP + self.hashes[self.codes[starts + j]])
        return found


def _cut(text: bytes, most: int) -> Iterator[bytes]:
    """Parts of a folded text that end where a piece ends, so that no phrase is cut."""
    at = 0
    while len(text) - at > most:
        end = text.find(b".", at + most)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[tuple[list[bytes], list[tuple]]]:
    """(folded texts, their (language, shard)) with about ``most`` bytes each time."""
    texts, marks, size = [], [], 0
    for batch in batches:
        columns = (batch[c].to_pylist() for c in ("_text", "_lang", "_shard"))
        for text, lang, shard in zip(*columns, strict=True):
            for part in _cut((text or "").encode().translate(_FOLD), most):
                texts.append(part)
                marks.append((lang, shard))
                size += len(part)
                if size >= most:
                    yield texts, marks
                    texts, marks, size = [], [], 0
    if texts:
        yield texts, marks


def words_of(texts: list[bytes], groups: np.ndarray) -> Words:
    """Words by code, with the number of words left in the piece from each of them on."""
    # A line feed, which no folded text holds, ends a text.
    joined = (b" \n ".join(t.replace(b".", b" . ") for t in texts) + b" \n ").replace(b"\t", b" ").decode()
    found = pc.split_pattern(pa.array([joined], pa.large_string()), " ").flatten()
    del joined
    coded = found.filter(pc.not_equal(found, "")).dictionary_encode()
    del found
    dictionary, codes = coded.dictionary, np.asarray(coded.indices)
    of_text, of_piece = (pc.index(dictionary, mark).as_py() for mark in ("\n", "."))
    text_end = codes == of_text
    at = np.arange(len(codes), dtype=np.int32)
    stops = np.where(text_end | (codes == of_piece), at, len(codes)).astype(np.int32)
    room = np.minimum.accumulate(stops[::-1])[::-1] - at
    group = groups.astype(np.int32)[np.cumsum(text_end, dtype=np.int32) - text_end]
    hashes = [xxhash.xxh64_intdigest(w) for w in pc.cast(dictionary, pa.large_binary()).to_pylist()]
    return Words(dictionary, np.array(hashes, dtype=np.uint64), codes, group, room)


def salts(marks: list[tuple]) -> np.ndarray:
    """A 64-bit value per (language, shard)."""
    return np.array([xxhash.xxh64_intdigest(f"{shard}:{lang}".encode()) for lang, shard in marks], dtype=np.uint64)


def salted(hashes: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return A.mix(hashes ^ salt)


def _bits(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return keys >> np.uint64(64 - bits), keys & np.uint64((1 << bits) - 1)


def holds(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether a key may be in the bitmap (64 bits a word)."""
    found = np.ones(len(keys), dtype=bool)
    for place in _bits(keys, bits):
        found &= (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found


def bitmap_of(keys: DataFrame, bits: int) -> Broadcast:
    """All ``key`` values as a bitmap of 2^bits bits; at most 2^(bits - 6) rows reach the driver."""
    mask = (1 << bits) - 1
    places = keys.select(F.explode(F.array(
        F.shiftrightunsigned("key", 64 - bits), F.col("key").bitwiseAND(F.lit(mask)))).alias("place"))
    word = places.select(F.shiftright("place", 6).cast("int").alias("at"),
                         F.expr("shiftleft(1L, cast(place & 63 AS int))").alias("bit"))
    rows = word.groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), dtype=np.int64)
    bitmap[np.asarray(rows["at"])] = np.asarray(rows["bit"])
    return keys.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))


def _texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, shards: int) -> DataFrame:
    return docs.select(
        F.col(f"`{text_col}`").cast("string").alias("_text"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("_lang"),
        F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(shards)).cast("int").alias("_shard"))


def locally_frequent(texts: DataFrame, length: int, shorter: Broadcast | None, plan: Mining) -> DataFrame:
    """``key`` of every phrase of ``length`` words that is frequent in its shard; no shard is cut short."""
    bits = plan.filter_bits

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, marks in slices(batches):
            salt = salts(marks)
            words = words_of(parts, np.arange(len(parts)))
            starts = words.runs(length)
            if shorter is not None:
                own = words.runs(length - 1)
                frequent = np.zeros(len(words.codes) + 1, dtype=bool)
                frequent[own] = holds(shorter.value, salted(words.run_hashes(own, length - 1), salt[words.group[own]]), bits)
                starts = starts[frequent[starts] & frequent[starts + 1]]
            keys = np.sort(salted(words.run_hashes(starts, length), salt[words.group[starts]]))
            if len(keys):
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                n = np.diff(np.append(first, len(keys)))
                found = pa.RecordBatch.from_arrays([pa.array(A.signed(keys[first])), pa.array(n)], names=["key", "n"])
                yield from (found.slice(a, BATCH) for a in range(0, len(first), BATCH))

    rows = texts.mapInArrow(counted, "key long, n long")
    return rows.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= plan.local_support).select("key")


def phrase_counts(texts: DataFrame, candidates: Broadcast, plan: Mining) -> DataFrame:
    """(lang, phrase, size, n): every word, and every candidate that occurs ``support`` times, counted exactly."""
    bits = plan.filter_bits

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, marks in slices(batches):
            langs, of_text = np.unique([lang for lang, _ in marks], return_inverse=True)
            words = words_of(parts, of_text)
            # By language, for a phrase may be frequent in another shard than that of its text.
            salt = np.stack([salts([(lang, shard) for lang in langs.tolist()]) for shard in range(plan.shards)])
            for length in range(1, plan.most + 1):
                starts = words.runs(length)
                if length > 1:
                    hashes, group = words.run_hashes(starts, length), words.group[starts]
                    found = np.zeros(len(starts), dtype=bool)
                    for own in salt:
                        found |= holds(candidates.value, salted(hashes, own[group]), bits)
                    starts = starts[found]
                if not len(starts):
                    continue
                ids = words.group[starts].astype(np.int64)
                for j in range(length):
                    if int(ids.max()) >= (1 << 62) // len(words.dictionary):
                        ids = np.unique(ids, return_inverse=True)[1].astype(np.int64)
                    ids = ids * len(words.dictionary) + words.codes[starts + j]
                _, at, n = np.unique(ids, return_index=True, return_counts=True)
                at = starts[at]
                phrase = words.dictionary.take(pa.array(words.codes[at]))
                for j in range(1, length):
                    phrase = pc.binary_join_element_wise(phrase, words.dictionary.take(pa.array(words.codes[at + j])), pa.scalar(" ", phrase.type))
                for a in range(0, len(at), BATCH):
                    b = min(len(at), a + BATCH)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(langs[words.group[at[a:b]]].tolist(), pa.string()), phrase.slice(a, b - a).cast(pa.string()),
                         pa.array(np.full(b - a, length, np.int32)), pa.array(n[a:b].astype(np.int64))],
                        names=["lang", "phrase", "size", "n"])

    rows = texts.mapInArrow(counted, "lang string, phrase string, size int, n long")
    totals = rows.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return totals.filter((F.col("size") == 1) | (F.col("n") >= plan.support))


def _wide(name: str) -> Column:
    return F.col(name).cast("decimal(19,0)")


def cut_scores(counts: DataFrame, plan: Mining) -> DataFrame:
    """(lang, phrase, size, a, l, r, score): each phrase at its lowest-scoring cut, the first of equal ones.

    score = floor(1,000,000 a a / (l r)) in integers of 38 digits.
    """
    phrases = counts.filter(F.col("size") >= plan.least).withColumnRenamed("n", "a")
    words = F.split("phrase", " ")
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).select(
        "lang", "phrase", "size", "a", "k",
        F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    both = cuts.join(left.hint("merge"), ["lang", "first"]).join(right.hint("merge"), ["lang", "rest"])
    product = both.select("lang", "phrase", "size", "a", "k", "l", "r",
                          (F.lit(1_000_000).cast("decimal(7,0)") * _wide("a") * _wide("a")).cast("decimal(38,0)").alias("above"),
                          (_wide("l") * _wide("r")).cast("decimal(38,0)").alias("below"))
    scored = product.withColumn("score", F.expr("above div below"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return scored.groupBy("lang", "phrase", "size", "a").agg(lowest).select(
        "lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def inside_longer(phrases: DataFrame, plan: Mining) -> DataFrame:
    """(lang, phrase, longest): how often the most frequent longer candidate around a phrase occurs."""
    words = F.split("phrase", " ")
    wide = phrases.filter(F.col("size") > plan.least)
    sized = wide.withColumn("part", F.explode(F.expr(f"sequence({plan.least}, size - 1)")))
    placed = sized.withColumn("at", F.explode(F.expr("sequence(1, size - part + 1)")))
    parts = placed.select("lang", F.array_join(F.slice(words, F.col("at"), F.col("part")), " ").alias("phrase"), "n")
    return parts.groupBy("lang", "phrase").agg(F.max("n").alias("longest"))


def mine(
    docs: DataFrame, plan: Mining = Mining(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases, from rank 1.

    Texts are folded from A-Z to a-z and cut into pieces at breaks; words are what spaces and tabs
    leave. ``n`` is the number of words of the language. A null text is empty, a null language
    ``und``. Ids only deal texts to shards, so null and repeated ones change nothing; every row counts,
    copies too. Texts longer than a slice are worked on in stretches of whole pieces (one piece longer
    than that is one stretch). Ties go by the number of occurrences, then to the lesser phrase in byte
    order. No text, or none with a frequent phrase, gives no row. Other columns are not read.
    """
    texts = _texts(docs, id_col, text_col, lang_col, plan.shards)
    frequent, shorter = [], None
    for length in range(2, plan.most + 1):
        found = written(locally_frequent(texts, length, shorter, plan), f"phrases-local-{length}")
        frequent.append(found)
        shorter = bitmap_of(found, plan.filter_bits)
    union = frequent[0]
    for more in frequent[1:]:
        union = union.unionByName(more)
    counts = written(phrase_counts(texts, bitmap_of(union, plan.filter_bits), plan), "phrases-counts")
    chosen = counts.filter(F.col("size") >= plan.least)
    scored = cut_scores(counts, plan)
    around = inside_longer(chosen, plan)
    kept = scored.join(around.hint("merge"), ["lang", "phrase"], "left").filter(
        F.col("longest").isNull() | (100 * _wide("longest") < plan.part_of_100 * _wide("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= plan.top)
    # One row per language, of a result that is itself bounded per language.
    totals = counts.filter("size = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals.hint("merge"), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(docs: DataFrame) -> DataFrame:
    return mine(docs)


ORACLE_SQL = r"""WITH d AS (
    SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
g AS (
    SELECT lang, 1 AS size, unnest(w) AS phrase FROM w
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) > 1
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
        FROM w WHERE len(w) > 2),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
cuts AS (
    SELECT lang, size, phrase, a, 1 AS k, w[1] AS first, array_to_string(w[2:], ' ') AS rest FROM c
    UNION ALL SELECT lang, size, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE size = 3),
s AS (
    SELECT x.lang, x.size, x.phrase, x.a, x.k, l.a AS l, r.a AS r,
        ((1000000::HUGEINT * x.a * x.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
    FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.first JOIN f r ON r.lang = x.lang AND r.phrase = x.rest),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
    SELECT lang, phrase, max(a) AS longest FROM (
        SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE size = 3
        UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE size = 3) GROUP BY lang, phrase),
kept AS (
    SELECT low.* FROM low LEFT JOIN around o ON o.lang = low.lang AND o.phrase = low.phrase
    WHERE o.longest IS NULL OR 100 * o.longest < 50 * low.a),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score
FROM ranked r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000"""
