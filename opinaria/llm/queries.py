"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from opinaria.llm import (
    classifier, debruijn, decontaminate, licenses, lm, phrases, pieces, rules, simhash, suffixes, token_files, topk, whitening,
)
from opinaria.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/embeddings.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.query(documents(spark, sf_dir))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.query(documents(spark, sf_dir))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.query(documents(spark, sf_dir))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(documents(spark, sf_dir))


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.query(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.query(documents(spark, sf_dir), read_table(spark, f"{sf_dir}/labels.parquet"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.query(documents(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.query(documents(spark, sf_dir), public_tokenizers.path(PIECES))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(documents(spark, sf_dir), read_table(spark, f"{sf_dir}/benchmark.parquet"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.query(documents(spark, sf_dir))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.query(embeddings(spark, sf_dir))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.query(documents(spark, sf_dir))


def op13_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.query(embeddings(spark, sf_dir))


QUERIES: dict[str, Query] = {
    q.__name__: q for q in (
        op1_license_scans, op2_lm_scoring, op3_suffix_array_dedup, op4_simhash_near_dedup, op5_token_id_output,
        op6_quality_classifier, op7_quality_rules, op8_sentencepiece, op9_decontamination, op10_substring_dedup,
        op11_embedding_whitening, op12_phrase_mining, op13_top_k_search)
}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scans": licenses.oracle_sql(), "op10_substring_dedup": debruijn.ORACLE_SQL,
            "op12_phrase_mining": phrases.ORACLE_SQL, "op13_top_k_search": topk.ORACLE_SQL}
