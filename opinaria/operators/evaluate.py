"""Sampling, splitting and scoring predictions against given labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinaria.functions.labels import NEGATIVE, POSITIVE

# Seeds, sample size and hold-out share of the original experiments.
SAMPLE_SEED = 42
SAMPLE_SIZE = 10
SPLIT_SEED = 9
TEST_SHARE = 0.2
HEAD_SIZE = 10
ANSWERED = (POSITIVE, NEGATIVE)


def seeded_hash(key: Column, seed: int) -> Column:
    """A digest of seed and row id: the same on every run, partitioning and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def is_test_row(key: Column, share: float = TEST_SHARE, seed: int = SPLIT_SEED) -> Column:
    """Whether a row belongs to the hold-out part; depends on the row id alone."""
    bound = format(min(int(share * 16**8), 16**8 - 1), "08x")
    if share >= 1:
        return F.lit(True)
    return F.substring(seeded_hash(key, seed), 1, 8) < bound


def split(
    df: DataFrame, key: str = "id", share: float = TEST_SHARE, seed: int = SPLIT_SEED
) -> tuple[DataFrame, DataFrame]:
    """(train, test): disjoint, complete, and stable when rows are added or moved."""
    test = is_test_row(F.col(key), share, seed)
    return df.filter(~test), df.filter(test)


def sample_rows(
    df: DataFrame, n: int = SAMPLE_SIZE, key: str = "id", seed: int = SAMPLE_SEED
) -> DataFrame:
    """Exactly n rows (fewer only if there are fewer), chosen by seeded digest."""
    return df.orderBy(seeded_hash(F.col(key), seed), key).limit(n)


def answered(df: DataFrame, prediction: str = "prediction", labels: Sequence[str] = ANSWERED) -> DataFrame:
    """Rows whose prediction is one of the expected labels."""
    return df.filter(F.col(prediction).isin(list(labels)))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy over all rows given."""
    return df.agg(_share_equal(label, prediction).alias("accuracy"))


def _share_equal(label: str, prediction: str) -> Column:
    return F.avg(F.coalesce(F.col(label) == F.col(prediction), F.lit(False)).cast("double"))


def accuracy_by(
    df: DataFrame, group: str, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Accuracy per group, such as per model."""
    return df.groupBy(group).agg(
        _share_equal(label, prediction).alias("accuracy"), F.count("*").alias("n")
    )


def accuracy_with_coverage(
    df: DataFrame, label: str = "label", prediction: str = "prediction",
    labels: Sequence[str] = ANSWERED,
) -> DataFrame:
    """Accuracy over answered rows beside the share of rows answered; no row if none was."""
    ok = F.col(prediction).isin(list(labels))
    right = F.coalesce(F.col(label) == F.col(prediction), F.lit(False)).cast("double")
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(ok).alias("n_answered"),
        F.avg(F.when(ok, F.lit(1.0)).otherwise(F.lit(0.0))).alias("coverage"),
        F.avg(F.when(ok, right)).alias("accuracy"),
    ).filter(F.col("n_answered") > 0)


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n) for every pair that occurs."""
    return df.groupBy(
        F.col(label).alias("label"), F.col(prediction).alias("prediction")
    ).agg(F.count("*").alias("n"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """(class, precision, recall, f1_score, support): one row per class, then ``accuracy``,
    ``macro avg`` and ``weighted avg``. The accuracy row fills only f1_score and support.

    Everything after the confusion counts works on at most (classes x classes) rows.
    """
    pairs = confusion(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("bigint")
    sides = pairs.select(F.inline(F.array(
        F.struct(F.col("label").alias("class"), hit.alias("tp"),
                 F.col("n").alias("support"), none.alias("predicted")),
        F.struct(F.col("prediction").alias("class"), none.alias("tp"),
                 none.alias("support"), F.col("n").alias("predicted")),
    )))
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    per_class = sides.groupBy("class").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
    ).select(
        "class", "tp", "support",
        _ratio(tp, predicted).alias("precision"),
        _ratio(tp, support).alias("recall"),
        # 2pr/(p+r) is 2tp/(predicted+support), which needs no case for p = r = 0.
        _ratio(2 * tp, predicted + support).alias("f1_score"),
    )
    measures = ("precision", "recall", "f1_score")

    def weighted(m: str) -> Column:
        return _ratio(F.sum(F.col(m) * support), F.sum(support)).alias(f"w_{m}")

    totals = per_class.agg(
        F.sum("support").alias("n"), F.sum("tp").alias("hits"),
        *[F.avg(m).alias(f"m_{m}") for m in measures], *[weighted(m) for m in measures],
    ).filter(F.col("n") > 0)
    blank = F.lit(None).cast("double")
    summary = totals.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), blank.alias("precision"),
                 blank.alias("recall"), (F.col("hits") / F.col("n")).alias("f1_score"),
                 F.col("n").alias("support")),
        *[
            F.struct(F.lit(name).alias("class"),
                     *[F.col(f"{p}_{m}").alias(m) for m in measures], F.col("n").alias("support"))
            for p, name in (("m", "macro avg"), ("w", "weighted avg"))
        ],
    )))
    return per_class.select("class", *measures, "support").unionByName(summary)


def head(df: DataFrame, key: str = "id", n: int = HEAD_SIZE) -> DataFrame:
    """First n rows in id order."""
    return df.orderBy(key).limit(n)


def unanswered_head(
    df: DataFrame, key: str = "id", label: str = "label", prediction: str = "prediction",
    n: int = HEAD_SIZE,
) -> DataFrame:
    """The raw answers to look at when nothing was answered; empty as soon as one row was.

    Answered rows sort first, so the first n rows show whether there is one.
    """
    ok = F.coalesce(F.col(prediction).isin(list(ANSWERED)), F.lit(False)).alias("_ok")
    first = df.select(key, label, prediction, ok).orderBy(F.desc("_ok"), key).limit(n)
    # The window sees n rows at most.
    any_answer = F.max("_ok").over(Window.partitionBy())
    return first.withColumn("_any", any_answer).filter(~F.col("_any")).drop("_ok", "_any")
