"""Train, evaluate and save sentiment models on labelled reviews."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinaria.operators import naive_bayes as nb
from opinaria.operators.evaluate import SPLIT_SEED, TEST_SHARE, accuracy_by, split
from opinaria.operators.tokens import MAX_FEATURES, vocabulary, word_array
from opinaria.sources.scratch import materialise


@dataclass(frozen=True)
class Training:
    """Word arrays of all rows, the fitted models by kind, hold-out predictions and accuracies."""

    words: DataFrame
    models: dict[str, nb.NaiveBayesModel]
    predictions: DataFrame
    accuracies: DataFrame

    def chosen(self, kind: str = nb.DEFAULT_MODEL) -> nb.NaiveBayesModel:
        """The model to keep: an explicit choice, Bernoulli unless told otherwise."""
        return self.models[kind]


def training_words(
    reviews: DataFrame, *, text: str = "text", label: str = "label", key: str = "id",
    language: Column | None = None,
    stop_words: Iterable[str] | Mapping[str, Iterable[str]] = (), stem: bool = True,
) -> DataFrame:
    """(id, label, words) of every labelled review: one narrow pass over the texts."""
    words = word_array(F.col(text), language=language, stop_words=stop_words, stem=stem)
    return reviews.filter(F.col(label).isNotNull()).select(
        F.col(key).alias("id"), F.col(label).alias("label"), words.alias("words")
    )


def train_and_evaluate(
    words: DataFrame, *, kinds: Sequence[str] = (nb.MULTINOMIAL, nb.BERNOULLI),
    labels: Sequence[str] | None = None, max_features: int = MAX_FEATURES,
    share: float = TEST_SHARE, seed: int = SPLIT_SEED, fit_on: str = "all",
) -> Training:
    """Vocabulary, hold-out split, one model per kind, predictions and accuracy per kind.

    ``fit_on='all'`` takes the vocabulary from every row, as the original experiment does;
    ``'train'`` takes it from the training part only. The words are written once, since the
    vocabulary, the fits and the predictions all read them, and each model is written before it is
    applied: what a later step reads is small, and no step repeats the text work.
    """
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on must be 'all' or 'train'")
    words = materialise(words, "words")
    names = tuple(sorted(labels)) if labels is not None else nb.class_labels(words)
    train, test = split(words, "id", share, seed)
    vocab = materialise(
        vocabulary(words if fit_on == "all" else train, "words", max_features), "vocab"
    )
    models = {
        kind: nb.materialised(
            nb.fit(train, kind=kind, vocab=vocab, labels=names, max_features=max_features)
        )
        for kind in kinds
    }
    predictions = nb.union_all([
        nb.predict_labelled(test, model).select(F.lit(kind).alias("model"), "id", "label", "prediction")
        for kind, model in models.items()
    ])
    return Training(words, models, predictions, accuracy_by(predictions, "model"))


def train_texts(
    reviews: DataFrame, preparation: nb.Preparation, *, text: str = "text", label: str = "label",
    key: str = "id", language: Column | None = None, **options,
) -> Training:
    """``train_and_evaluate`` on texts; its models carry the preparation with them."""
    words = reviews.filter(F.col(label).isNotNull()).select(
        F.col(key).alias("id"), F.col(label).alias("label"),
        preparation.words(F.col(text), language).alias("words"),
    )
    done = train_and_evaluate(words, **options)
    models = {kind: replace(model, preparation=preparation) for kind, model in done.models.items()}
    return replace(done, models=models)


def predict_texts(
    texts: DataFrame, model: nb.NaiveBayesModel, *, text: str = "text", key: str = "id",
    language: Column | None = None,
    stop_words: Iterable[str] | Mapping[str, Iterable[str]] | None = None, stem: bool | None = None,
) -> DataFrame:
    """(key, prediction) for texts, prepared as the model's training texts were.

    A model without a preparation of its own takes ``stop_words`` (default: none) and ``stem``
    (default: yes); one that has it takes neither, so that training and scoring cannot differ.
    """
    preparation = model.preparation
    if preparation is None:
        preparation = nb.Preparation(() if stop_words is None else stop_words, stem is not False)
    elif stop_words is not None or stem is not None:
        raise ValueError("this model brings its own stop words and stemming")
    words = preparation.words(F.col(text), language)
    return nb.predict(texts.select(key, words.alias("words")), model, key=key)
