"""Additive training: counts per class and term that merge by sums, and models made from them.

A saved model cannot grow; its counts can. Each batch of labelled texts is counted by itself, over all of
its terms, and kept. Any set of batches gives the model that training on all their texts at once gives,
vocabulary included, and no text is read again. The Gaussian model needs one more sum, of squares.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinaria.operators import naive_bayes as nb
from opinaria.operators.dimension import lookup_join
from opinaria.operators.tokens import MAX_FEATURES, index_terms, term_rows, top_terms
from opinaria.sources.scratch import materialise

CLASSES, TERMS = "classes", "terms"
# Fixed value: the share of the greatest variance that is added to every variance.
VARIANCE_SHARE = 1e-9


@dataclass(frozen=True)
class TrainingCounts:
    """``classes`` (label, n) and ``terms`` (label, term, occurrences, texts, squares).

    ``squares`` sums the squared occurrences per text.
    """

    classes: DataFrame
    terms: DataFrame


def count_texts(training: DataFrame, key: str = "id", label: str = "label", words: str = "words") -> TrainingCounts:
    """The counts of one batch, rows without a label left out; every term counts, not only a vocabulary's."""
    known = training.filter(F.col(label).isNotNull())
    classes = known.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    rows = term_rows(known, key, F.col(label).alias("label"), words=words)
    per_text = rows.groupBy(key, "label", "term").agg(F.count("*").alias("x"))
    terms = per_text.groupBy("label", "term").agg(
        F.sum("x").alias("occurrences"), F.count("*").alias("texts"), F.sum(F.col("x") * F.col("x")).alias("squares"))
    return TrainingCounts(classes, terms)


def save_counts(counts: TrainingCounts, path: str, version: str) -> None:
    """Keep a batch below ``path`` under its own name; a name is written once."""
    counts.classes.write.parquet(f"{path}/{version}/{CLASSES}")
    counts.terms.write.parquet(f"{path}/{version}/{TERMS}")


def load_counts(spark: SparkSession, path: str, versions: Sequence[str]) -> TrainingCounts:
    """The sum of the named batches."""
    return merge([
        TrainingCounts(spark.read.parquet(f"{path}/{v}/{CLASSES}"), spark.read.parquet(f"{path}/{v}/{TERMS}"))
        for v in versions])


def merge(parts: Sequence[TrainingCounts]) -> TrainingCounts:
    """Sums over all parts; the same whichever way parts are merged."""
    classes = reduce(DataFrame.unionByName, [p.classes for p in parts])
    terms = reduce(DataFrame.unionByName, [p.terms for p in parts])
    sums = [F.sum(c).alias(c) for c in ("occurrences", "texts", "squares")]
    return TrainingCounts(classes.groupBy("label").agg(F.sum("n").alias("n")), terms.groupBy("label", "term").agg(*sums))


def vocabulary_of(counts: TrainingCounts, max_features: int = MAX_FEATURES) -> DataFrame:
    """(term, term_idx) of the terms with the most occurrences in all classes."""
    totals = counts.terms.groupBy("term").agg(F.sum("occurrences").alias("n"))
    return index_terms(top_terms(totals, max_features))


def _grid(counts: TrainingCounts, vocab: DataFrame, labels: Sequence[str], columns: Sequence[str], max_features: int) -> DataFrame:
    """(label, term, columns) for every class and vocabulary term, zeros included.

    One aggregate with columns per class, so the zeros need no product of classes and terms.
    """
    known = lookup_join(counts.terms, vocab.select("term"), ["term"], known_rows=max_features)
    none = F.lit(0).cast("bigint")
    unseen = vocab.select("term", F.lit(None).cast("string").alias("label"), *[none.alias(c) for c in columns])
    summed = known.select("term", "label", *columns).unionByName(unseen).groupBy("term").agg(*[
        F.sum(F.when(F.col("label") == name, F.col(c)).otherwise(none)).alias(f"{c}_{i}")
        for i, name in enumerate(labels) for c in columns])
    rows = F.array(*[
        F.struct(F.lit(name).alias("label"), *[F.col(f"{c}_{i}").alias(c) for c in columns]) for i, name in enumerate(labels)])
    return summed.select("term", F.inline(rows)).select("label", "term", *columns)


def _priors(counts: TrainingCounts) -> DataFrame:
    # One row per class.
    total = F.sum("n").over(Window.partitionBy())
    return counts.classes.withColumn("log_prior", F.log(F.col("n") / total))


def model_of(
    counts: TrainingCounts, kind: str = nb.DEFAULT_MODEL, *, vocab: DataFrame | None = None,
    max_features: int = MAX_FEATURES, alpha: float = nb.ALPHA,
) -> nb.NaiveBayesModel:
    """The multinomial or Bernoulli model of these counts; without ``vocab`` the vocabulary is theirs."""
    labels = nb.class_labels(counts.classes)
    terms = vocab if vocab is not None else vocabulary_of(counts, max_features)
    column = "texts" if kind == nb.BERNOULLI else "occurrences"
    grid = _grid(counts, terms, labels, [column], max_features).withColumnRenamed(column, "n")
    priors = _priors(counts)
    return nb.NaiveBayesModel(kind, labels, terms, priors, nb.WEIGHTS[kind](grid, priors, alpha), max_features)


@dataclass(frozen=True)
class GaussianModel:
    """``weights`` (term, linear_i, square_i for the class i): a text in which a term occurs x times scores
    x * linear - x * x * square for it, and the row of ``BASE_TERM`` once. That row holds the prior and what
    the absence of the whole vocabulary scores, so no text meets its absent terms.
    """

    labels: tuple[str, ...]
    weights: DataFrame
    max_features: int = MAX_FEATURES


def gaussian_model(
    counts: TrainingCounts, *, vocab: DataFrame | None = None, max_features: int = MAX_FEATURES,
) -> GaussianModel:
    """Means and variances per class and term from the sums; the greatest variance widens all of them."""
    labels = nb.class_labels(counts.classes)
    terms = vocab if vocab is not None else vocabulary_of(counts, max_features)
    # At most one row per vocabulary term and class from here on.
    grid = materialise(_grid(counts, terms, labels, ["occurrences", "squares"], max_features), "gaussian-grid")
    priors = materialise(_priors(counts), "gaussian-priors")
    n = priors.agg(F.sum("n").alias("n")).first()["n"] or 1
    overall = grid.groupBy("term").agg(F.sum("occurrences").alias("s"), F.sum("squares").alias("ss"))
    widest = overall.agg(F.max(F.col("ss") / F.lit(float(n)) - (F.col("s") / F.lit(float(n))) ** 2).alias("v")).first()["v"]
    floor = VARIANCE_SHARE * (widest if widest and widest > 0 else 1.0)
    mean = F.col("occurrences") / F.col("n")
    rows = grid.join(F.broadcast(priors), "label").select(
        "label", "term", "log_prior", mean.alias("m"), (F.col("squares") / F.col("n") - mean * mean + floor).alias("v"))
    parts = rows.select("label", "term", (F.col("m") / F.col("v")).alias("linear"), (0.5 / F.col("v")).alias("square"))
    absent = F.sum(0.5 * F.log(2 * math.pi * F.col("v")) + F.col("m") * F.col("m") / (2 * F.col("v")))
    base = rows.groupBy("label").agg((F.max("log_prior") - absent).alias("linear")).select(
        "label", F.lit(nb.BASE_TERM).alias("term"), "linear", F.lit(0.0).alias("square"))
    wide = parts.unionByName(base).groupBy("term").agg(*[
        F.max(F.when(F.col("label") == name, F.col(c))).alias(f"{c}_{i}")
        for i, name in enumerate(labels) for c in ("linear", "square")])
    return GaussianModel(labels, wide, max_features)


def gaussian_scores(texts: DataFrame, model: GaussianModel, key: str = "id", words: str = "words") -> DataFrame:
    """(key, scores): an array of (label, score) per text; a text without vocabulary words has the base scores."""
    present = F.coalesce(F.col(words), F.array().cast("array<string>"))
    rows = texts.select(key, F.explode(F.concat(F.array(F.lit(nb.BASE_TERM)), present)).alias("term"))
    known = lookup_join(rows, model.weights.select("term"), ["term"], "left_semi", known_rows=model.max_features + 1)
    times = known.groupBy(key, "term").agg(F.count("*").alias("x"))
    met = lookup_join(times, model.weights, ["term"], known_rows=model.max_features + 1)
    x = F.col("x")
    sums = met.groupBy(key).agg(*[
        F.sum(x * F.col(f"linear_{i}") - x * x * F.col(f"square_{i}")).alias(f"s_{i}") for i in range(len(model.labels))])
    return sums.select(key, F.array(*[
        F.struct(F.lit(name).alias("label"), F.col(f"s_{i}").alias("score")) for i, name in enumerate(model.labels)
    ]).alias("scores"))


def predict_gaussian(texts: DataFrame, model: GaussianModel, key: str = "id", words: str = "words") -> DataFrame:
    """(key, prediction) for every text."""
    scores = gaussian_scores(texts, model, key, words)
    return scores.select(key, nb.best_label(F.col("scores")).alias("prediction"))
