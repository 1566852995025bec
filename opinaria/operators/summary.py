"""Label distributions, label filters and table profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinaria.functions.labels import ALL_LABELS
from opinaria.functions.text import clean_text


def drop_empty(df: DataFrame, column: str = "texto") -> DataFrame:
    """Rows whose text is neither null nor empty."""
    return df.filter(F.col(column) != "")


def cleaned_rows(df: DataFrame, text: Column, *keep: str | Column) -> DataFrame:
    """(keep…, texto): cleaned texts, empty ones dropped.

    A filter on the cleaned column would be pushed below it and clean every text twice. Unnesting
    a list of one or no text is not pushed, so each text is cleaned once.
    """
    some = F.array_remove(F.array(clean_text(text)), "")
    return df.select(*keep, F.explode_outer(some).alias("texto")).filter(F.col("texto").isNotNull())


def label_counts(df: DataFrame, column: str) -> DataFrame:
    """(label, n), most frequent first, equal counts by label; null labels are not counted."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "label")
    )


def label_counts_by_scorer(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(scorer, label, n) over the label columns the table has."""
    present = [c for c in columns if c in df.columns]
    pairs = F.array(*[
        F.struct(F.lit(c).alias("scorer"), F.col(c).alias("label")) for c in present
    ])
    return (
        df.select(F.inline(pairs)).filter(F.col("label").isNotNull())
        .groupBy("scorer", "label").agg(F.count("*").alias("n"))
        .orderBy("scorer", F.desc("n"), "label")
    )


def filter_by_label(df: DataFrame, column: str, label: str) -> DataFrame:
    """Rows with one label, or every row for the all-labels choice."""
    return df if label == ALL_LABELS else df.filter(F.col(column) == label)


def table_profile(df: DataFrame) -> DataFrame:
    """(column, type, rows, non_null): the shape and fill of a table in one pass."""
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)],
    )
    return counts.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(t).alias("type"),
            F.col("_rows").alias("rows"), F.col(f"_{i}").alias("non_null"),
        )
        for i, (c, t) in enumerate(df.dtypes)
    ])))


def text_lengths(df: DataFrame, column: str) -> DataFrame:
    """One row: number of texts, shortest and longest length."""
    size = F.length(column).cast("bigint")
    return df.agg(
        F.count(column).alias("n"), F.min(size).alias("shortest"), F.max(size).alias("longest")
    )
