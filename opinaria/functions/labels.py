"""Sentiment labels as native columns: mapping, parsing, thresholds, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinaria.functions.text import strip_whitespace

# The label domain, the review label map and the compound-score bounds.
POSITIVE = "positivo"
NEGATIVE = "negativo"
NEUTRAL = "neutro"
UNCLASSIFIED = "nao_classificado"
FAILED = "erro"
ALL_LABELS = "Todos"
REVIEW_LABELS = {"pos": POSITIVE, "neg": NEGATIVE}
NEUTRAL_HINTS = ("neutro", "neutra", "neither")
POSITIVE_BOUND = 0.05
NEGATIVE_BOUND = -0.05


def map_review_label(label: Column) -> Column:
    """pos/neg to the full words; any other value to null."""
    mapped = F.lit(None).cast("string")
    for short, full in REVIEW_LABELS.items():
        mapped = F.when(label == short, F.lit(full)).otherwise(mapped)
    return mapped


def normalise_label(answer: Column) -> Column:
    """Free-text answer to a label: the first label word found, in order of precedence."""
    lowered = F.lower(answer)
    neutral = F.lit(False)
    for hint in NEUTRAL_HINTS:
        neutral = neutral | lowered.contains(hint)
    return (
        F.when(lowered.contains(POSITIVE), F.lit(POSITIVE))
        .when(lowered.contains(NEGATIVE), F.lit(NEGATIVE))
        .when(neutral, F.lit(NEUTRAL))
        .otherwise(F.lit(UNCLASSIFIED))
    )


def strict_label(answer: Column, error: Column) -> Column:
    """Two-class answer: exact label after trimming, else unclassified; a failed call is an error."""
    word = F.lower(strip_whitespace(answer))
    return (
        F.when(F.coalesce(error, F.lit(False)) | answer.isNull(), F.lit(FAILED))
        .when(word.isin(POSITIVE, NEGATIVE), word)
        .otherwise(F.lit(UNCLASSIFIED))
    )


def label_from_compound(compound: Column) -> Column:
    """Compound score to a label; both bounds are inclusive."""
    return (
        F.when(compound >= POSITIVE_BOUND, F.lit(POSITIVE))
        .when(compound <= NEGATIVE_BOUND, F.lit(NEGATIVE))
        .otherwise(F.lit(NEUTRAL))
    )


def as_percent(share: Column) -> Column:
    """A share as text with two decimals, for display only."""
    return F.format_string("%.2f%%", share * 100)
