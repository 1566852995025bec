"""A pipeline over ``documents``: quality, near-duplicates, repeated passages, benchmarks, token ids.

Each stage takes what its predecessor kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinaria.llm import classifier, debruijn, decontaminate, pieces, queries, simhash
from opinaria.sources.scratch import materialise
from opinaria.sources.shipping import ship_package
from opinaria.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    It learns from at most 20,000 labelled documents, chosen by hash; the held-out quarter is left out.
    """
    ship_package(spark)
    return classifier.keep_good(docs, read_table(spark, f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (4-word shingles, 4 bits of their SimHash) the document with the least id stays."""
    ship_package(spark)
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words and more are cut; a document of which nothing stays goes.

    A text without such a passage stays as it is; of another, the words that stay are joined by a space.
    """
    ship_package(spark)
    done = debruijn.remove_repeated_words(docs)
    cut = F.col("cut.n_removed") > 0
    text = F.when(cut, F.col("cut.kept")).otherwise(F.col("row.text"))
    rows = done.filter(~cut | (F.col("cut.kept") != "")).select(
        *(text.alias("text") if c == "text"
          else F.when(cut, F.length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c)
          if c == "n_chars" else F.col(f"row.{c}") for c in docs.columns))
    return rows


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    ship_package(spark)
    return decontaminate.keep_clean(docs, read_table(spark, f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of the query of this operator, for what is left."""
    ship_package(spark)
    return pieces.query(docs, public_tokenizers.path(queries.PIECES))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near-duplicates", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]
# The fitted rules, XXH64 fingerprints and subword ids are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again as the next one's documents."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{i}")
    return docs
