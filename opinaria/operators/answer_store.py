"""Answers kept by prompt: a text whose prompt was answered before is never paid for again.

Each run adds one folder of (digest, answer, error) to the store; nothing in it is ever changed, and a run
that fails half-way leaves no folder that a reader would see. A prompt is known if any run has its
answer. Failed calls are kept too, but do not make a prompt known, so the next run asks it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinaria.operators.dimension import lookup_join
from opinaria.operators.external import THREE_CLASS_PROMPT, Scorer, ask, lenient_answer, render_prompt, strict_answer

ANSWERS = "digest string, answer string, error boolean"


def create_store(spark: SparkSession, path: str) -> None:
    """An empty store; an existing one is an error."""
    spark.createDataFrame([], ANSWERS).write.parquet(f"{path}/run=none")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(digest, answer, error, run) of all runs."""
    return spark.read.schema(ANSWERS + ", run string").option("basePath", path).parquet(path)


def known_answers(spark: SparkSession, path: str) -> DataFrame:
    """(digest, answer, run): one row per answered prompt; of several answers that of the first run by name."""
    good = read_store(spark, path).filter(~F.col("error") & F.col("answer").isNotNull())
    first = F.min(F.struct("run", "answer")).alias("first")
    return good.groupBy("digest").agg(first).select("digest", F.col("first.answer").alias("answer"), F.col("first.run").alias("run"))


def digest_of(prompt: Column, scorer_name: str) -> Column:
    """Names a prompt to one scorer; another scorer's answers are not this one's."""
    return F.sha2(F.concat(F.lit(scorer_name), F.lit("\x00"), prompt), 256)


def ask_new(texts: DataFrame, path: str, run: str, factory: Callable[[], Scorer], scorer_name: str, prompt: str) -> None:
    """Ask for every prompt that no run has answered, each distinct one once, and keep the answers as ``run``.

    The calls are made while the run's folder is written, and nothing reads the plan again. A null prompt
    is not asked.
    """
    spark = texts.sparkSession
    prompts = texts.filter(F.col(prompt).isNotNull()).select(
        digest_of(F.col(prompt), scorer_name).alias("digest"), F.col(prompt).alias("_prompt"))
    new = prompts.groupBy("digest").agg(F.first("_prompt").alias("_prompt")).join(
        known_answers(spark, path).select("digest"), "digest", "left_anti")
    ask(new, "_prompt", factory).select("digest", "answer", "error").write.parquet(f"{path}/run={run}")


def score_kept(
    texts: DataFrame, path: str, run: str, factory: Callable[[], Scorer], column: str, *, scorer_name: str = "",
    text: str = "texto", template: str | None = THREE_CLASS_PROMPT, strict: bool = False,
) -> DataFrame:
    """The texts with a label column and ``run``, the run that answered them (null: none has yet).

    ``run`` names this run, once. A text asked in vain is labelled as a failed call.
    """
    prompt = F.col(text) if template is None else render_prompt(F.col(text), template)
    prepared = texts.withColumn("_prompt", prompt)
    ask_new(prepared, path, run, factory, scorer_name, "_prompt")
    named = prepared.withColumn("_digest", digest_of(F.col("_prompt"), scorer_name)).drop("_prompt")
    answers = known_answers(texts.sparkSession, path).select(F.col("digest").alias("_digest"), F.col("answer").alias("_answer"), "run")
    rule = strict_answer if strict else lenient_answer
    joined = lookup_join(named, answers, ["_digest"], "left")
    label = rule(F.col("_answer"), F.col("_digest").isNotNull() & F.col("_answer").isNull())
    return joined.withColumn(column, label).select(*texts.columns, column, "run")
