"""Check an external classifier on a sample of labelled reviews, and view labelled files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinaria.functions.labels import map_review_label
from opinaria.operators import evaluate, external
from opinaria.operators.summary import label_counts
from opinaria.sources.files import LABELLED_COLUMNS, read_labelled
from opinaria.sources.scratch import materialise

PREDICTION = "predicao_gemini"


@dataclass(frozen=True)
class AnswerCheck:
    """Sampled rows (id, sentiment, predicao_gemini) and the reports on them."""

    sample: DataFrame

    def coverage(self) -> DataFrame:
        return evaluate.accuracy_with_coverage(self.sample, "sentiment", PREDICTION)

    def report(self) -> DataFrame:
        return evaluate.classification_report(
            evaluate.answered(self.sample, PREDICTION), "sentiment", PREDICTION
        )

    def examples(self) -> DataFrame:
        return evaluate.head(evaluate.answered(self.sample, PREDICTION))

    def unanswered(self) -> DataFrame:
        return evaluate.unanswered_head(self.sample, "id", "sentiment", PREDICTION)


def review_sample(reviews: DataFrame, n: int = evaluate.SAMPLE_SIZE, seed: int = evaluate.SAMPLE_SEED) -> DataFrame:
    """(id, text_pt, sentiment) of n reviews, the sentiment in full words."""
    sampled = evaluate.sample_rows(reviews.select("id", "text_pt", "sentiment"), n, "id", seed)
    return sampled.withColumn("sentiment", map_review_label(F.col("sentiment")))


def check_answers(
    reviews: DataFrame, factory: Callable[[], external.Scorer], n: int = evaluate.SAMPLE_SIZE,
    seed: int = evaluate.SAMPLE_SEED,
) -> AnswerCheck:
    """Sample, ask, and parse the answers by the strict two-class rule."""
    prompted = review_sample(reviews, n, seed).select(
        "id", "sentiment", external.review_prompt(F.col("text_pt")).alias("_prompt")
    )
    asked = external.ask(prompted, "_prompt", factory)
    label = external.strict_answer(F.col("answer"), F.col("error"))
    return AnswerCheck(materialise(asked.select("id", "sentiment", label.alias(PREDICTION)), "answers"))


def labelled_file_counts(
    spark: SparkSession, path: str, column: str = "sent_gpt5", multi_line: bool = True
) -> DataFrame:
    """Label distribution of a labelled file."""
    required = tuple(c if c != "sent_gpt5" else column for c in LABELLED_COLUMNS)
    return label_counts(read_labelled(spark, path, required, multi_line), column)
