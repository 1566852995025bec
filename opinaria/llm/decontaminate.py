"""Benchmark decontamination by templates: passages of benchmark items, also with other values filled in.

Words become a template: numbers, units after them and names are typed slots, the
rest is lower-cased and loses its punctuation. Windows of template words are hash-joined with those of
the items; a run of matching windows counts if the slots of item and document map one to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinaria.llm import arrays as A
from opinaria.llm.steps import written

WINDOW, LEAST_RUN, LEAST_WORDS, LEAST_LITERALS = 8, 13, 5, 4
# Windows of the items that tasks may hold to sift their documents by; beyond it, all windows are joined.
MOST_SIFTED = 2_000_000
NUMBER, UNIT, NAME = 1, 2, 3
# Unit names and signs.
UNITS = frozenset((
    "%", "percent", "kg", "g", "mg", "km", "m", "cm", "mm", "mi", "ft", "in", "l", "ml", "s", "ms", "min", "h", "kmh", "mph",
    "kilograms", "grams", "kilometers", "kilometres", "meters", "metres", "centimeters", "miles", "feet", "inches",
    "liters", "litres", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "dollars", "cents", "euros",
    "pounds", "degrees", "€", "$", "£", "jahre", "stunden", "tage", "años", "horas", "días", "heures", "jours", "ans",
))
WINDOWS = "_id long, form int, size int, at int, h long, slots array<string>"
PASSAGES = "doc_id long, item_id long, n_words int, n_slots int, exact boolean"


def word_facts(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Bare form of each word, and columns: hash, is empty, is a number, is a unit, is capital, ends a sentence."""
    bare, facts = [], []
    for word in words:
        inner = "".join(c for c in word if c.isalnum())
        low = inner.lower()
        number = low[:1].isdigit()
        capital = inner[:1].isupper() and not (len(inner) > 1 and inner.isupper())
        sign = low or (word if word in UNITS else "")
        bare.append(sign)
        facts.append((xxhash.xxh64_intdigest(sign, 42), not sign, number, sign in UNITS, capital, word[-1:] in ".!?:;"))
    columns = np.array(facts, dtype=np.uint64).reshape(-1, 6)
    return bare, columns


class Form(NamedTuple):
    """The template words of all texts in one form: codes, own hashes, which are slots, words per text, first and last bare word."""

    codes: np.ndarray
    own: np.ndarray
    slots: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    last: np.ndarray


def templates(texts: pa.Array) -> tuple[list[Form], np.ndarray, list[str]]:
    """The forms of all texts, the code of every bare word, and the words of the codes.

    Form 0 has slots for numbers and units, form 1 for names inside a sentence as well: a text in other
    letter case shows its names in form 0 only. In form 2 capitals that begin a sentence are names too,
    and neighbouring names of a sentence are one slot.
    """
    words, lengths = A.text_words(texts)
    coded = words.dictionary_encode()
    bare, facts = word_facts(coded.dictionary.to_pylist())
    at = np.asarray(coded.indices)
    rows = facts[at]
    docs = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.concatenate([[1], rows[:-1, 5]]).astype(bool)
    first = np.concatenate([[True], docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, bool)
    begins = ends[: len(docs)] | first
    keep = rows[:, 1] == 0
    rows, docs, begins, at = rows[keep], docs[keep], begins[keep], at[keep]
    number = rows[:, 2] == 1
    after = np.concatenate([[False], number[:-1] & (docs[1:] == docs[:-1])]) if len(docs) else np.zeros(0, bool)
    unit = (rows[:, 3] == 1) & after
    name = (rows[:, 4] == 1) & ~begins & ~number & ~unit
    plain = np.where(number, np.uint64(NUMBER), np.where(unit, np.uint64(UNIT), rows[:, 0]))
    typed = np.where(name, np.uint64(NAME), plain)
    each = np.arange(len(docs))
    sizes = np.bincount(docs, minlength=len(lengths))
    capital = (rows[:, 4] == 1) & ~number & ~unit
    goes_on = np.zeros(len(docs), dtype=bool)
    goes_on[1:] = capital[1:] & capital[:-1] & ~begins[1:]
    first = np.flatnonzero(~goes_on)
    last = np.concatenate([first[1:] - 1, [len(docs) - 1]]) if len(docs) else first
    whole = A.Rolling(A.mix(rows[:, 0])).runs(first, last + 1)
    folded = np.where(capital, np.uint64(NAME), plain)[first]
    return [
        Form(plain, rows[:, 0], number | unit, sizes, each, each),
        Form(typed, rows[:, 0], number | unit | name, sizes, each, each),
        Form(folded, whole, (number | unit | capital)[first], np.bincount(docs[first], minlength=len(lengths)), first, last),
    ], at, bare


def window_rows(batch: pa.RecordBatch, sizes: list[int], sift: dict[int, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Template windows of the given sizes; ``sift`` holds the sorted hashes per size that are looked for."""
    forms, words, bare = templates(batch["_text"])
    ids = np.asarray(pc.fill_null(batch["_id"], 0))
    for form, (codes, own, slots, lengths, first, last) in enumerate(forms):
        docs = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
        start = A.starts_of(lengths)
        rolling, exact = A.Rolling(A.mix(codes)), A.Rolling(A.mix(own))
        literal = np.concatenate([[0], np.cumsum(~slots)])
        for size in sizes:
            keys = A.signed(rolling.all_runs(size))
            if not len(keys):
                continue
            # Windows with hardly a literal tell by their values only.
            dense = literal[size:] - literal[: len(keys)] < min(LEAST_LITERALS, size)
            keys = np.where(dense, A.signed(exact.all_runs(size)), keys)
            ok = docs[: len(keys)] == docs[size - 1 :]
            if sift is not None:
                wanted = sift[size]
                place = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                ok &= wanted[place] == keys
            for chosen in np.array_split(at := np.flatnonzero(ok), max(1, len(at) // 50_000)):
                if not len(chosen):
                    continue
                inside = [[" ".join(bare[k] for k in words[first[j] : last[j] + 1]) for j in range(p, p + size) if slots[j]]
                          for p in chosen.tolist()]
                owner = docs[chosen]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[owner]), pa.array(np.full(len(chosen), form, np.int32)),
                    pa.array(np.full(len(chosen), size, np.int32)), pa.array((chosen - start[owner]).astype(np.int32)),
                    pa.array(keys[chosen]), pa.array(inside, pa.list_(pa.string())),
                ], names=["_id", "form", "size", "at", "h", "slots"])


def windows_of(texts: DataFrame, sizes: list[int], sift: dict[int, np.ndarray] | None = None) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.slices(whole, "_text"):
                yield from window_rows(batch, sizes, sift)

    return texts.mapInArrow(A.tidy(made), WINDOWS)


def item_sizes(texts: DataFrame) -> DataFrame:
    """(_id, form, words): the template words of each item in each form."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for form, parts in enumerate(templates(batch["_text"])[0]):
                kind = pa.array(np.full(batch.num_rows, form, np.int32))
                yield pa.RecordBatch.from_arrays([batch["_id"], kind, pa.array(parts.lengths.astype(np.int32))],
                                                 names=["_id", "form", "words"])

    return texts.mapInArrow(A.tidy(counted), "_id long, form int, words int")


def consistent(windows: list[tuple[int, list[str], list[str]]]) -> tuple[int, int, bool] | None:
    """(windows, slot values, exact) of neighbouring windows whose slots map one to one, else None."""
    pairs = {pair for _, mine, theirs in windows for pair in zip(mine, theirs, strict=True)}
    if len({a for a, _ in pairs}) < len(pairs) or len({b for _, b in pairs}) < len(pairs):
        return None
    return len({w[0] for w in windows}), len(pairs), all(a == b for a, b in pairs)


def neighbours(windows: list[tuple[int, list[str], list[str]]]) -> Iterator[list[tuple[int, list[str], list[str]]]]:
    """Stretches of windows at places without a gap."""
    run: list[tuple[int, list[str], list[str]]] = []
    for window in sorted(windows):
        if run and window[0] > run[-1][0] + 1:
            yield run
            run = []
        run.append(window)
    if run:
        yield run


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The longest passage of each alignment of a document and an item, if it is long enough."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            best = None
            for run in neighbours([(w["item_at"], w["item_slots"], w["slots"]) for w in row["found"]]):
                whole = consistent(run)
                # Where values conflict, the parts that hold the item's own values still count.
                parts = [whole] if whole else map(consistent, neighbours([w for w in run if w[1] == w[2]]))
                for n, values, exact in filter(None, parts):
                    n += row["size"] - 1
                    if n >= min(LEAST_RUN, row["words"]):
                        best = max(best or (0, False, 0), (n, exact, values))
            if best:
                out.append({"doc_id": row["doc_id"], "item_id": row["item_id"], "n_words": best[0],
                            "n_slots": best[2], "exact": best[1]})
        yield pa.RecordBatch.from_pylist(out, pa.schema([
            ("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int32()), ("n_slots", pa.int32()), ("exact", pa.bool_())]))


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", most_sifted: int = MOST_SIFTED,
) -> DataFrame:
    """(doc_id, item_id, n_words, n_slots, exact): documents that hold a passage of an item.

    A passage is a run of at least 13 template words of the item, or all of a shorter one (of 5 words
    or more; fewer tell nothing), whose slots map one to one: an item value always to the same
    document value, different ones to different ones. Each run is judged by itself; of one whose slots
    conflict, parts of that length with the item's own values count, parts with other values do not. ``n_words`` is the longest run, ``n_slots`` its
    slots' values, ``exact`` whether none differs. A window with fewer than 4 words besides its slots
    matches the same words only, not other values. Null and empty texts and items match nothing, nor do
    rows without an id. Rows of one id count as one document. Empty tables give an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).filter("_id IS NOT NULL")
    asked = items.select(F.col(item_id).cast("long").alias("_id"), F.col(item_text).cast("string").alias("_text")).filter("_id IS NOT NULL")
    lengths = written(item_sizes(asked).filter(F.col("words") >= LEAST_WORDS), "item-sizes")
    short = [r[0] for r in lengths.filter(F.col("words") < WINDOW).select("words").distinct().collect()]
    sizes = sorted({*short, WINDOW})
    mine = windows_of(asked, sizes).join(lengths, ["_id", "form"]).filter(
        (F.col("size") == F.least(F.lit(WINDOW), "words"))).withColumnsRenamed(
        {"_id": "item", "at": "item_at", "slots": "item_slots"})
    mine = written(mine, "item-windows")
    sift, small = None, mine.count() <= most_sifted
    if small:
        known = mine.select("size", "h").distinct().collect()
        sift = {s: np.sort(np.array([r[1] for r in known if r[0] == s] or [0], dtype=np.int64)) for s in sizes}
    found = windows_of(rows, sizes, sift)
    pairs = found.join(F.broadcast(mine) if small else mine.hint("merge"), ["form", "size", "h"])
    aligned = pairs.groupBy("form", F.col("_id").alias("doc_id"), F.col("item").alias("item_id"),
                            (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.first("words").alias("words"), F.first("size").alias("size"),
        F.collect_set(F.struct("item_at", "item_slots", "slots")).alias("found"))
    judged = aligned.select("doc_id", "item_id", "words", "size", "found").mapInArrow(A.tidy(judge), PASSAGES)
    best = judged.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", "exact", "n_slots")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_words", "m.n_slots", "m.exact")


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contaminated(docs, items)


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a passage of an item, with all their columns."""
    hit = contaminated(docs, items).select("doc_id").distinct()
    return docs.join(hit.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
