"""Documents as word arrays, word tables and bags of words.

A document arrives as one row, and its words stay in that row as an array for as long as possible.
Rows per word exist inside a task only; what leaves it is pre-aggregated per term or per document.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinaria.functions.stemming import stem_word, stem_words
from opinaria.functions.text import drop_words, drop_words_by_language, tokens
from opinaria.operators.dimension import lookup_join

# The default size of the vocabulary and the shortest word a bag of words keeps.
MAX_FEATURES = 1000
MIN_TERM_LENGTH = 2


def word_array(
    text: Column,
    *,
    language: Column | None = None,
    stop_words: Iterable[str] | Mapping[str, Iterable[str]] = (),
    stem: bool = False,
) -> Column:
    """Words of a text after the optional stop-word and stemming steps, in reading order.

    ``stop_words`` is one list, or a mapping of language code to list used with ``language``.
    """
    words = tokens(text)
    if isinstance(stop_words, Mapping):
        if stop_words:
            words = drop_words_by_language(words, language, stop_words)
    else:
        words = drop_words(words, stop_words)
    return stem_words(words) if stem else words


def explode_words(df: DataFrame, words: str, *keep: str) -> DataFrame:
    """One row per word: the kept columns, the 0-based position and the term."""
    return df.select(*keep, F.posexplode_outer(words).alias("pos", "term")).filter(
        F.col("term").isNotNull()
    )


def term_rows(
    df: DataFrame, *keep: str, words: str = "words", distinct: bool = False
) -> DataFrame:
    """One row per word that is long enough for a bag of words: the kept columns and the term.

    ``distinct`` gives each term once per document, found inside the row. The outer form of explode
    keeps the optimizer from putting a size filter in front, which would tokenise every text again.
    """
    source = F.array_distinct(words) if distinct else F.col(words)
    rows = df.select(*keep, F.explode_outer(source).alias("term"))
    return rows.filter(F.length("term") >= MIN_TERM_LENGTH)


def without_stop_words(
    word_rows: DataFrame, stop_words: DataFrame, on: tuple[str, ...] = ("term",)
) -> DataFrame:
    """Rows whose word is not in the stop-word table; ``on`` may add a language column."""
    return lookup_join(word_rows, stop_words.select(*on).distinct(), list(on), "left_anti")


def bag_of_words(df: DataFrame, key: str = "id", words: str = "words") -> DataFrame:
    """(key, term, n): occurrences of every term in every document.

    A document is one row, so the partial counts of its task are final already: what shuffles is one
    row per document and term, and nothing does when the documents lie hashed or bucketed on the key.
    """
    return term_rows(df, key, words=words).groupBy(key, "term").agg(F.count("*").alias("n"))


def term_frequencies(df: DataFrame, words: str = "words") -> DataFrame:
    """Total occurrences of every term."""
    return term_rows(df, words=words).groupBy("term").agg(F.count("*").alias("n"))


def top_terms(frequencies: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """The most frequent terms; equal counts in alphabetical order, so the choice is total."""
    return frequencies.orderBy(F.desc("n"), "term").limit(max_features)


def index_terms(terms: DataFrame) -> DataFrame:
    """(term, term_idx), indexed from 0 in alphabetical order; for a chosen, bounded set of terms."""
    place = F.row_number().over(Window.orderBy("term")) - 1
    return terms.select("term", place.cast("bigint").alias("term_idx"))


def vocabulary(
    df: DataFrame, words: str = "words", max_features: int = MAX_FEATURES
) -> DataFrame:
    """(term, term_idx) of the most frequent terms."""
    return index_terms(top_terms(term_frequencies(df, words), max_features))


def first_terms(vocab: DataFrame, n: int = 50) -> DataFrame:
    """The alphabetically first n terms."""
    return vocab.orderBy("term").limit(n)


def document_terms(
    df: DataFrame, vocab: DataFrame, key: str = "id", words: str = "words",
    max_features: int | None = None,
) -> DataFrame:
    """Sparse document-term matrix (key, term_idx, n); words outside the vocabulary vanish.

    The vocabulary is joined before the counting, so only its terms are counted and shuffled. State
    its size as ``max_features`` only where it is known; else it is counted.
    """
    known = lookup_join(term_rows(df, key, words=words), vocab, ["term"], known_rows=max_features)
    return known.groupBy(key, "term_idx").agg(F.count("*").alias("n"))


def stem_vocabulary(frequencies: DataFrame) -> DataFrame:
    """(term, n, stem) over distinct terms: each form is stemmed once, however often it occurs."""
    return frequencies.select("term", "n", stem_word(F.col("term")).alias("stem"))


def stem_frequencies(frequencies: DataFrame) -> DataFrame:
    """Total occurrences per stem, from the occurrences per term."""
    return (
        stem_vocabulary(frequencies)
        .groupBy(F.col("stem").alias("term"))
        .agg(F.sum("n").alias("n"))
    )
