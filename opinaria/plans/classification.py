"""Collect or load texts, label them with both scorers, write the results, summarise."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinaria.functions.text import preview
from opinaria.operators import external
from opinaria.operators.lexicon import with_lexicon_label
from opinaria.operators.summary import filter_by_label, label_counts_by_scorer
from opinaria.sources import files
from opinaria.sources.posts import collect_texts
from opinaria.sources.scratch import checkpoint, materialise


@dataclass(frozen=True)
class Classified:
    """Classified rows (id, origem, texto, sent_gemini[, sent_vader]) and where they were written."""

    rows: DataFrame
    written_to: str | None

    def counts(self) -> DataFrame:
        return label_counts_by_scorer(self.rows, (files.MODEL_LABEL, files.LEXICON_LABEL))

    def table(self, label: str) -> DataFrame:
        """Rows of one label (or all), the text cut for display."""
        chosen = filter_by_label(self.rows, files.MODEL_LABEL, label)
        return chosen.withColumn("texto", preview(F.col("texto")))


def classify(
    texts: DataFrame, *, responses: DataFrame | None = None,
    factory: Callable[[], external.Scorer] | None = None,
    lexicon: DataFrame | None = None, context: bool = True,
) -> DataFrame:
    """Label (id, origem, texto) rows.

    The first label comes from a response table or from a scorer made by ``factory``; the second,
    from a lexicon, is there only when a lexicon is given.
    """
    if (responses is None) == (factory is None):
        raise ValueError("give either responses or a scorer factory")
    if responses is not None:
        labelled = external.label_from_responses(texts, responses, files.MODEL_LABEL)
    else:
        labelled = external.score_with(texts, factory, files.MODEL_LABEL)
    if lexicon is None:
        return labelled
    # Scored from the texts themselves: reading the labelled rows again would ask the scorer again.
    return with_lexicon_label(texts, lexicon, files.LEXICON_LABEL, context=context, to=labelled)


def _finish(spark: SparkSession, texts: DataFrame, target: str, **scorers) -> Classified:
    if texts.isEmpty():
        return Classified(classify(texts, **scorers), None)
    # A scorer may be slow or paid for, so its labels are written before two reports read them.
    rows = materialise(classify(texts, **scorers), "classified")
    files.write_results(rows, target, "id")
    return Classified(rows, target)


def run_search(
    spark: SparkSession, posts: DataFrame, comments: DataFrame, keyword: str, folder: str,
    post_limit: int = 8, comment_limit: int = 5, **scorers,
) -> Classified:
    """Keyword search over posts: raw export, labels, results file."""
    found = collect_texts(posts, comments, keyword, post_limit, comment_limit)
    ids = checkpoint(found.orderBy("post_id", "pos").withColumn("id", F.monotonically_increasing_id()))
    files.write_raw_texts(ids, f"{folder}/{files.raw_output_name(keyword)}", "id")
    texts = ids.select("id", "origem", "texto")
    return _finish(spark, texts, f"{folder}/{files.results_output_name(keyword)}", **scorers)


def run_file(
    spark: SparkSession, path: str, folder: str, text_column: str = files.TEXT_COLUMN,
    multi_line: bool = True, **scorers,
) -> Classified:
    """Comment file: labels and results file."""
    loaded = files.read_manual_texts(spark, path, text_column, multi_line)
    # Ids in reading order, fixed by the checkpoint so that joins on them see the same ones.
    texts = checkpoint(loaded.select(F.monotonically_increasing_id().alias("id"), "origem", "texto"))
    return _finish(spark, texts, f"{folder}/{files.file_results_name(path)}", **scorers)
