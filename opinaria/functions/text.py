"""Text cleaning as native columns: every function maps Column to Column, no Python runs per row."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes and patterns the cleaning rules are defined by.
# A tag ends at the first '>' on its own line, so a tag broken over two lines is kept.
# Java's \s is ASCII only; the class below is the Unicode white space the rules mean.
WHITESPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_WHITESPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
TAG = r"<[^>\n]*>"
URL = r"https?://" + NOT_WHITESPACE + "+"
NOT_ALPHANUMERIC = r"[^\p{L}\p{N}]"
PREVIEW_LENGTH = 180
ELLIPSIS = "…"

# English contractions which the standard word tokeniser splits in two.
SPLIT_CONTRACTIONS = (
    ("can", "not"),
    ("gim", "me"),
    ("gon", "na"),
    ("got", "ta"),
    ("lem", "me"),
    ("wan", "na"),
)


def strip_tags(text: Column, replacement: str = "") -> Column:
    """Remove markup tags; ``replacement`` is '' for training text and ' ' for collected text."""
    return F.regexp_replace(text, TAG, replacement)


def strip_urls(text: Column) -> Column:
    """Replace each http(s) address (lower-case scheme only) by one space."""
    return F.regexp_replace(text, URL, " ")


def collapse_whitespace(text: Column) -> Column:
    """Make every run of Unicode white space one space and drop the outer ones."""
    return F.trim(F.regexp_replace(text, WHITESPACE + "+", " "))


def strip_whitespace(text: Column) -> Column:
    """Drop leading and trailing Unicode white space only."""
    return F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def clean_text(text: Column) -> Column:
    """Tags, then addresses, then white space; null becomes ''."""
    spaced = strip_tags(text, " ")
    return F.coalesce(collapse_whitespace(strip_urls(spaced)), F.lit(""))


def spaces_for_specials(text: Column) -> Column:
    """Replace each character that is neither a letter nor a number by one space."""
    return F.regexp_replace(text, NOT_ALPHANUMERIC, " ")


def normalise(text: Column) -> Column:
    """Training text before word filtering: no tags, no special characters, lower case."""
    return F.lower(spaces_for_specials(strip_tags(text)))


def tokens(text: Column) -> Column:
    """Words of the normalised text in reading order; null or wordless text gives an empty array."""
    # One replacement per run of separators leaves a text that a plain one-space split can cut.
    spaced = F.lower(F.regexp_replace(strip_tags(text), NOT_ALPHANUMERIC + "+", " "))
    halves = "|".join(f"({a})({b})" for a, b in SPLIT_CONTRACTIONS)
    first = "".join(f"${2 * i + 1}" for i in range(len(SPLIT_CONTRACTIONS)))
    second = "".join(f"${2 * i + 2}" for i in range(len(SPLIT_CONTRACTIONS)))
    # (?<![^ ]) and (?![^ ]) hold at a space and at either end of the text.
    spaced = F.regexp_replace(spaced, f"(?<![^ ])(?:{halves})(?![^ ])", f"{first} {second}")
    words = F.array_remove(F.split(F.trim(spaced), " "), "")
    return F.coalesce(words, F.array().cast("array<string>"))


def drop_words(words: Column, stop_words: Iterable[str]) -> Column:
    """Filter an array of words against a fixed list, keeping order and repeats."""
    listed = list(stop_words)
    return F.filter(words, lambda w: ~w.isin(listed)) if listed else words


def drop_words_by_language(
    words: Column, language: Column, stop_words: Mapping[str, Iterable[str]]
) -> Column:
    """As ``drop_words`` with one list per language code; other languages pass unchanged."""
    kept = words
    for code, listed in stop_words.items():
        kept = F.when(language == code, drop_words(words, listed)).otherwise(kept)
    return kept


def rejoin(words: Column) -> Column:
    """One text again, words separated by a space."""
    return F.array_join(words, " ")


def preview(text: Column, length: int = PREVIEW_LENGTH) -> Column:
    """The text, or its first ``length`` characters and an ellipsis when it is longer."""
    cut = F.concat(F.substring(text, 1, length), F.lit(ELLIPSIS))
    return F.when(F.length(text) > length, cut).otherwise(text)
