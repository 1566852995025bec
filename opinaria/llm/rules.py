"""Quality rules whose cut-offs follow from the corpus: quantile sketches per language and source.

Statistics of each text are computed once; KLL sketches of them are built per (language, source), and
merged to sketches per language and of everything, on which groups lean, the more the smaller they are. A
text goes if a statistic lies beyond its group's fence. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinaria.llm.steps import written

BLANK = "[\\x20\\x09-\\x0D]+"
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
# A quantile of a group of n texts has the weight n / (n + LEAN), the rest is its language's, which leans on all texts
# in the same way; so one text more or less never swaps a fence.
LEAN = 50
SKETCH_K = 200
# A fence lies beyond the outer quantile by its distance to the inner one (of shares the median, so that a zero
# quartile range still leaves a fence of the group), and at least by FLOOR, so that equal texts are no outliers.
OUTER, MARGIN, FLOOR = 0.95, 1.0, 0.01
# Statistic -> (outer quantile, inner quantile) per side.
UPPER = {"symbol_share": (OUTER, 0.5), "dup_line_share": (OUTER, 0.5), "repeat_share": (OUTER, 0.5), "mean_word": (OUTER, 1 - OUTER)}
LOWER = {"mean_word": (1 - OUTER, OUTER)}


def statistics(text: Column) -> list[Column]:
    """The base counts of a text."""
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return [
        words.alias("words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    ]


def repeated_words(words: Column) -> Column:
    """Words covered by windows of three words that occur twice or more in the text.

    Windows are hashed and sorted with their places; equal neighbours give the places of repeated
    windows, and each place covers what the next one does not.
    """
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    windows = F.when(F.size(words) > 3, F.transform(
        F.sequence(F.lit(1), F.size(words) - 2),
        lambda i: F.struct(F.xxhash64(words[i - 1], words[i], words[i + 1]).alias("h"), i.cast("int").alias("i")),
    )).otherwise(empty)
    return F.sort_array(windows)


def covered(ordered: Column) -> Column:
    """The number of words that the repeated windows of a sorted array cover."""
    def equal(a: Column, b: Column) -> Column:
        return F.coalesce(F.get(ordered, a)["h"] == F.get(ordered, b)["h"], F.lit(False))

    twice = F.filter(ordered, lambda x, j: equal(j, j - 1) | equal(j, j + 1))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate(places, start, lambda acc, i: F.struct(
        i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")))
    return total["n"]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             source_col: str = "source") -> DataFrame:
    """One row of counts and shares per text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    first = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"),
                        F.col(source_col).cast("string").alias("_source"), *statistics(text))
    second = first.select(
        "_id", "_lang", "_source", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"), repeated_words(F.col("words")).alias("ordered"))
    counts = second.select("*", covered(F.col("ordered")).alias("n_repeat_words")).drop("ordered")

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return counts.select(
        "*", share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("word_chars", "n_words").alias("mean_word"),
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
        .alias("base_failed"))


STATISTICS = tuple(dict.fromkeys((*UPPER, *LOWER)))


def sketches(rows: DataFrame) -> DataFrame:
    """(_lang, _source, n, one sketch per statistic) of the texts that passed the base rules."""
    made = [F.kll_sketch_agg_double(c, SKETCH_K).alias(c) for c in STATISTICS]
    return rows.filter("NOT base_failed").groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"), *made)


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(c, SKETCH_K).alias(c) for c in STATISTICS))


def fences(parts: DataFrame) -> DataFrame:
    """One row per (language, source): the lowest and highest value that each statistic may have."""
    asked = sorted({(c, q) for side in (UPPER, LOWER) for c, both in side.items() for q in both})

    def quantiles(prefix: str) -> list[Column]:
        return [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(F.col(c), F.lit(q))).alias(f"{prefix}_{i}")
                for i, (c, q) in enumerate(asked)]

    own = parts.select("_lang", "_source", F.col("n").alias("n_own"), *quantiles("own"))
    by_lang = merged(parts, "_lang").select("_lang", F.col("n").alias("n_lang"), *quantiles("lang"))
    # Eight numbers at most, whatever the input: of everything, for languages with few texts.
    everything = merged(parts).select(*quantiles("all")).first().asDict()
    joined = own.alias("o").join(by_lang.alias("l"), F.expr("o._lang <=> l._lang")).select(
        "o.*", *(c for c in by_lang.columns if c != "_lang"))

    def leaning(n: str, own: Column, wider: Column) -> Column:
        """``own`` by the weight of its texts, and ``wider`` for the rest."""
        return wider + (own - wider) * F.col(n) / (F.col(n) + LEAN)

    def chosen(c: str, q: float) -> Column:
        i = asked.index((c, q))
        lang = leaning("n_lang", F.col(f"lang_{i}"), F.lit(everything[f"all_{i}"]).cast("double"))
        return leaning("n_own", F.col(f"own_{i}"), lang)

    def fence(c: str, side: str, outer: float, inner: float) -> Column:
        at = chosen(c, outer)
        reach = F.greatest(F.lit(MARGIN) * F.abs(at - chosen(c, inner)), F.lit(FLOOR))
        return (at + reach if side == "upper" else at - reach).alias(f"{side}_{c}")

    return joined.select("_lang", "_source", *(fence(c, "upper", *v) for c, v in UPPER.items()),
                         *(fence(c, "lower", *v) for c, v in LOWER.items()))


def judged(docs: DataFrame, **columns: str) -> DataFrame:
    """The counts of every text with base_failed and kept.

    Null texts have no words, and so fail; null languages and sources are groups of their own. Every
    row is judged, rows that repeat an id included; an empty table gives an empty table.
    """
    rows = written(measured(docs, **columns), "quality-statistics")
    limits = written(fences(written(sketches(rows), "quality-sketches")), "quality-fences")
    inside = [F.col(c) <= F.col(f"upper_{c}") for c in UPPER] + [F.col(c) >= F.col(f"lower_{c}") for c in LOWER]
    within = F.lit(True)
    for test in inside:
        within = within & F.coalesce(test, F.lit(True))
    joined = rows.alias("r").join(limits.alias("f"), F.expr("r._lang <=> f._lang AND r._source <=> f._source"), "left")
    names = [c for c in rows.columns]
    return joined.withColumn("kept", ~F.col("base_failed") & within).select(*(f"r.{c}" for c in names), "kept")


def query(docs: DataFrame) -> DataFrame:
    return judged(docs).select(F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                               "n_repeat_words", "base_failed", "kept")
