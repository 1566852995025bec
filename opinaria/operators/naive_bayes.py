"""Naive Bayes for word arrays as aggregates and one lookup join.

Class statistics are counts over word rows, pre-aggregated per task to at most one row per
vocabulary term. A model is three small tables. Scoring joins the words with the broadcast weights
and sums per document; the words themselves never shuffle. The Bernoulli model counts each term
once per document, which an array function settles inside the document's own row.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinaria.operators.dimension import MAX_BROADCAST_ROWS, lookup_join
from opinaria.operators.tokens import MAX_FEATURES, term_rows, vocabulary, word_array
from opinaria.sources.scratch import materialise

# Additive smoothing, and the two model families that are trained.
ALPHA = 1.0
MULTINOMIAL = "multinomial"
BERNOULLI = "bernoulli"
GAUSSIAN = "gaussian"
DEFAULT_MODEL = BERNOULLI
# Scores are compared at this many decimals, so that the summing order cannot decide a tie.
SCORE_DIGITS = 6
MAX_CLASSES = 1000
# The weights of this pseudo-term hold what a class scores for a text without vocabulary words.
# No word is empty, so the name is free.
BASE_TERM = ""


@dataclass(frozen=True)
class Preparation:
    """How a text becomes words: the stop words (one list, or lists by language code) and stemming."""

    stop_words: Iterable[str] | Mapping[str, Iterable[str]] = ()
    stem: bool = True

    def words(self, text: Column, language: Column | None = None) -> Column:
        if isinstance(self.stop_words, Mapping) and language is None:
            raise ValueError("stop words by language need a language column")
        return word_array(text, language=language, stop_words=self.stop_words, stem=self.stem)


PREPARATION_ROWS = "by_language boolean, stem boolean, lang string, term string"


@dataclass(frozen=True)
class NaiveBayesModel:
    """``vocab`` (term, term_idx), ``priors`` (label, n, log_prior), ``term_weights`` (label, term,
    weight), where the row of ``BASE_TERM`` is the score every text of that class starts from.

    ``preparation``, where known, is how the texts became words; new texts are prepared the same way.
    """

    kind: str
    labels: tuple[str, ...]
    vocab: DataFrame
    priors: DataFrame
    term_weights: DataFrame
    max_features: int = MAX_FEATURES
    preparation: Preparation | None = None


def class_labels(training: DataFrame, label: str = "label") -> tuple[str, ...]:
    """The classes of a training set in sorted order."""
    rows = (
        training.filter(F.col(label).isNotNull()).select(label).distinct()
        .limit(MAX_CLASSES + 1).collect()
    )
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes: {label} does not look like a label")
    return tuple(sorted(r[0] for r in rows))


def class_priors(training: DataFrame, labels: Sequence[str], label: str = "label") -> DataFrame:
    """(label, n, log_prior) with log_prior = ln(n_c / n), without smoothing."""
    counts = (
        training.filter(F.col(label).isin(list(labels)))
        .groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    )
    # One row per class, so the window over all of them is small.
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("log_prior", F.log(F.col("n") / total))


def class_term_counts(
    training: DataFrame, vocab: DataFrame, labels: Sequence[str], *, per_document: bool,
    label: str = "label", words: str = "words", max_features: int = MAX_FEATURES,
) -> DataFrame:
    """(label, term, n) for every class and vocabulary term, zeros included.

    n is the number of documents with the term if ``per_document``, else of its occurrences. One
    aggregate with a column per class counts all classes, so the zeros need no product of classes
    and terms.
    """
    rows = term_rows(
        training.filter(F.col(label).isin(list(labels))), label, words=words, distinct=per_document
    )
    if max_features > MAX_BROADCAST_ROWS:
        # The rows of one word are alike and would share a salt, so they are counted before the join.
        rows = rows.groupBy(label, "term").agg(F.count("*").alias("_n"))
    else:
        rows = rows.withColumn("_n", F.lit(1).cast("bigint"))
    known = lookup_join(rows, vocab.select("term"), ["term"], known_rows=max_features)
    # One row without a label per term: a term the training split never shows gets its zeros too.
    none = F.lit(0).cast("bigint")
    unseen = vocab.select("term", F.lit(None).cast("string").alias(label), none.alias("_n"))
    counted = known.select("term", label, "_n").unionByName(unseen).groupBy("term").agg(*[
        F.sum(F.when(F.col(label) == name, F.col("_n")).otherwise(none)).alias(f"n_{i}")
        for i, name in enumerate(labels)
    ])
    per_class = F.array(*[
        F.struct(F.lit(name).alias("label"), F.col(f"n_{i}").alias("n"))
        for i, name in enumerate(labels)
    ])
    return counted.select("term", F.inline(per_class)).select("label", "term", "n")


def multinomial_weights(counts: DataFrame, priors: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """weight = ln((n + a) / (sum n + a V)); the base weight is the log prior."""
    # A class has one row per vocabulary term here.
    of_class = Window.partitionBy("label")
    total = F.sum("n").over(of_class) + alpha * F.count("*").over(of_class)
    terms = counts.select(
        "label", "term", F.log((F.col("n") + alpha) / total).alias("weight")
    ).join(priors.select("label"), "label", "left_semi")
    base = priors.select("label", F.lit(BASE_TERM).alias("term"), F.col("log_prior").alias("weight"))
    return terms.unionByName(base)


def bernoulli_weights(counts: DataFrame, priors: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """With p = (n + a) / (n_c + 2a), weight = ln p - ln(1 - p).

    Every absent term costs ln(1 - p). The base weight charges that for the whole vocabulary, and
    the weight of a present term takes its share back, so no text meets its absent terms.
    """
    p = (F.col("n") + alpha) / (F.col("n_c") + 2 * alpha)
    classes = priors.select("label", F.col("n").alias("n_c"), "log_prior")
    logs = counts.join(F.broadcast(classes), "label").select(
        "label", "term", "log_prior", F.log(p).alias("present"), F.log(1 - p).alias("absent")
    )
    terms = logs.select("label", "term", (F.col("present") - F.col("absent")).alias("weight"))
    absent = logs.groupBy("label").agg(F.sum("absent").alias("absent"))
    base = priors.join(F.broadcast(absent), "label", "left").select(
        "label", F.lit(BASE_TERM).alias("term"),
        (F.col("log_prior") + F.coalesce("absent", F.lit(0.0))).alias("weight"),
    )
    return terms.unionByName(base)


WEIGHTS = {MULTINOMIAL: multinomial_weights, BERNOULLI: bernoulli_weights}


def fit(
    training: DataFrame, *, kind: str = DEFAULT_MODEL, vocab: DataFrame | None = None,
    labels: Sequence[str] | None = None, label: str = "label", words: str = "words",
    alpha: float = ALPHA, max_features: int = MAX_FEATURES,
) -> NaiveBayesModel:
    """Fit on rows with a label and a word array.

    Without ``vocab`` the vocabulary comes from these same rows. Pass the vocabulary of the whole
    set to fit it before the split, as the original experiment does.
    """
    if kind not in WEIGHTS:
        raise ValueError(f"kind must be one of {sorted(WEIGHTS)}")
    names = tuple(sorted(labels)) if labels is not None else class_labels(training, label)
    if len(names) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    if vocab is not None:
        # A vocabulary from elsewhere is counted, as its size decides how it is joined.
        max_features = vocab.count()
    terms = vocab if vocab is not None else vocabulary(training, words, max_features)
    priors = class_priors(training, names, label)
    counts = class_term_counts(
        training, terms, names, per_document=kind == BERNOULLI, label=label, words=words,
        max_features=max_features,
    )
    weights = WEIGHTS[kind](counts, priors, alpha)
    return NaiveBayesModel(kind, names, terms, priors, weights, max_features)


def _wide_weights(model: NaiveBayesModel) -> DataFrame:
    """One row per term with one weight column per class."""
    return model.term_weights.groupBy("term").agg(*[
        F.max(F.when(F.col("label") == name, F.col("weight"))).alias(f"w_{i}")
        for i, name in enumerate(model.labels)
    ])


def class_scores(
    texts: DataFrame, model: NaiveBayesModel, *, key: str = "id", words: str = "words"
) -> DataFrame:
    """(key, scores): an array of (label, score) per text, labels in sorted order.

    Every text gets the base term, so the inner join keeps texts without any vocabulary word.
    """
    source = F.array_distinct(words) if model.kind == BERNOULLI else F.col(words)
    rows = texts.select(
        key, F.explode_outer(F.concat(F.array(F.lit(BASE_TERM)), source)).alias("term")
    )
    weighted = lookup_join(
        rows, _wide_weights(model), ["term"], known_rows=model.max_features + 1
    )
    sums = weighted.groupBy(key).agg(
        *[F.sum(f"w_{i}").alias(f"s_{i}") for i in range(len(model.labels))]
    )
    return sums.select(key, F.array(*[
        F.struct(F.lit(name).alias("label"), F.round(f"s_{i}", SCORE_DIGITS).alias("score"))
        for i, name in enumerate(model.labels)
    ]).alias("scores"))


def score_rows(scores: DataFrame, key: str = "id") -> DataFrame:
    """(key, label, score), one row per text and class."""
    return scores.select(key, F.inline("scores"))


def best_label(scores: Column) -> Column:
    """The label with the highest score; a tie goes to the alphabetically first label.

    A class the training rows never showed has no weights and a null score, and is never chosen.
    """
    known = F.filter(scores, lambda s: s["score"].isNotNull())
    ranked = F.transform(
        known, lambda s: F.struct((-s["score"]).alias("cost"), s["label"].alias("label"))
    )
    return F.array_min(ranked)["label"]


def predict(
    texts: DataFrame, model: NaiveBayesModel, *, key: str = "id", words: str = "words"
) -> DataFrame:
    """(key, prediction) for every text."""
    scores = class_scores(texts, model, key=key, words=words)
    return scores.select(key, best_label(F.col("scores")).alias("prediction"))


def predict_labelled(
    texts: DataFrame, model: NaiveBayesModel, *, key: str = "id", label: str = "label",
    words: str = "words",
) -> DataFrame:
    """(key, label, prediction): the true label rides along, which saves joining it back."""
    packed = texts.select(F.struct(key, label).alias("_row"), words)
    scored = class_scores(packed, model, key="_row", words=words)
    return scored.select(
        F.col(f"_row.{key}").alias(key), F.col(f"_row.{label}").alias(label),
        best_label(F.col("scores")).alias("prediction"),
    )


def save_model(model: NaiveBayesModel, path: str) -> None:
    """Write the model as Parquet tables below ``path``."""
    named = model.vocab.sparkSession.createDataFrame(
        [(i, name, model.kind, model.max_features) for i, name in enumerate(model.labels)],
        "label_idx int, label string, kind string, max_features int",
    )
    named.coalesce(1).write.parquet(f"{path}/labels")
    for name in ("vocab", "priors", "term_weights"):
        # One file, after the aggregate has run in parallel.
        getattr(model, name).repartition(1).write.parquet(f"{path}/{name}")
    model.vocab.sparkSession.createDataFrame(
        _preparation_rows(model.preparation), PREPARATION_ROWS
    ).coalesce(1).write.parquet(f"{path}/preparation")


def _preparation_rows(preparation: Preparation | None) -> list[tuple]:
    """A row with neither language nor term says that there is a preparation; then one per stop word."""
    if preparation is None:
        return []
    by_language, stem = isinstance(preparation.stop_words, Mapping), preparation.stem
    lists = preparation.stop_words if by_language else {None: preparation.stop_words}
    return [(by_language, stem, None, None)] + [
        (by_language, stem, lang, term) for lang, listed in lists.items() for term in listed]


def _preparation_of(rows: Sequence) -> Preparation | None:
    if not rows:
        return None
    lists: dict[str | None, list[str]] = {}
    for row in rows:
        if row["term"] is not None:
            lists.setdefault(row["lang"], []).append(row["term"])
    return Preparation(lists if rows[0]["by_language"] else lists.get(None, []), rows[0]["stem"])


def load_model(spark: SparkSession, path: str) -> NaiveBayesModel:
    """Read a model written by ``save_model``."""
    named = spark.read.parquet(f"{path}/labels").orderBy("label_idx").limit(MAX_CLASSES + 1)
    rows = named.collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {path}")
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in ("vocab", "priors", "term_weights")}
    # As many rows as the stop-word lists that the model was given in memory.
    preparation = spark.read.schema(PREPARATION_ROWS).parquet(f"{path}/preparation").collect()
    return NaiveBayesModel(
        rows[0]["kind"], tuple(r["label"] for r in rows), max_features=rows[0]["max_features"],
        preparation=_preparation_of(preparation), **tables
    )


def materialised(model: NaiveBayesModel) -> NaiveBayesModel:
    """The same model with its weights written once, so that scoring does not repeat the training."""
    return replace(
        model, term_weights=materialise(model.term_weights.repartition(1), f"weights-{model.kind}")
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
