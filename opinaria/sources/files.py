"""Delimited text files: labelled reviews, comments, labelled results."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinaria.operators.row_ids import with_row_ids, with_row_ids_within
from opinaria.operators.summary import cleaned_rows
from opinaria.sources.posts import MANUAL, checked_keyword

# Separators, column names and file names of the exchanged files.
REVIEW_SEPARATOR = ","
SEPARATOR = ";"
TEXT_COLUMN = "comentario/review"
REVIEW_COLUMNS = ("text_pt", "sentiment")
LABELLED_COLUMNS = ("origem", "sent_gpt5", "texto")
MODEL_LABEL = "sent_gemini"
LEXICON_LABEL = "sent_vader"
RAW_NAME = "reddit_{keyword}_raw.csv"
RESULTS_NAME = "reddit_{keyword}_results.csv"
FILE_RESULTS_SUFFIX = "_results.csv"


def csv_options(separator: str = SEPARATOR, multi_line: bool = True) -> dict[str, object]:
    """Reader options. With ``multi_line`` a quoted value may hold line breaks, and a file is read
    by one task; turn it off for large files of one record per line, which are then split."""
    return {
        "sep": separator, "header": True, "quote": '"', "escape": '"', "multiLine": multi_line,
        "encoding": "UTF-8",
    }


def read_csv(
    spark: SparkSession, path: str, required: tuple[str, ...], separator: str = SEPARATOR,
    multi_line: bool = True,
) -> DataFrame:
    """All columns as strings, named by the header; a missing required column is an error.

    So are files of different headers in one folder. Folder names such as keyword=007 stay strings.
    """
    options = csv_options(separator, multi_line)
    names = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    df = spark.read.schema(schema).options(**options, enforceSchema=False).csv(path)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return df


def read_reviews(
    spark: SparkSession, path: str, columns: tuple[str, str] = REVIEW_COLUMNS,
    multi_line: bool = True,
) -> DataFrame:
    """(text_pt, sentiment) from a comma-separated review file; other columns are not read."""
    df = read_csv(spark, path, columns, REVIEW_SEPARATOR, multi_line)
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, REVIEW_COLUMNS)])


def manual_texts(raw: DataFrame, text_column: str = TEXT_COLUMN) -> DataFrame:
    """(origem, texto) from raw comment rows, batch or stream: cleaned, empty texts dropped."""
    return cleaned_rows(raw, F.col(f"`{text_column}`"), F.lit(MANUAL).alias("origem"))


def read_manual_texts(
    spark: SparkSession, path: str, text_column: str = TEXT_COLUMN, multi_line: bool = True
) -> DataFrame:
    """Texts of a comment file."""
    return manual_texts(read_csv(spark, path, (text_column,), multi_line=multi_line), text_column)


def read_labelled(
    spark: SparkSession, path: str, required: tuple[str, ...] = LABELLED_COLUMNS,
    multi_line: bool = True,
) -> DataFrame:
    """A labelled file with all its columns, if it has the required ones."""
    return read_csv(spark, path, required, multi_line=multi_line)


def _writer(df: DataFrame) -> DataFrameWriter:
    return df.write.options(
        sep=SEPARATOR, header=True, quote='"', escape='"', emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


# The writers number the rows first: that is checkpointed, so asking whether there are any rows reads
# the checkpoint and does not run the plan of the input (searches, scorers) again.


def write_raw_texts(df: DataFrame, path: str, *order: str) -> bool:
    """Write (id, comentario/review) with dense ids in ``order``; nothing for an empty table."""
    numbered = with_row_ids(df.select("texto", *[c for c in order if c != "texto"]), *order, name="_id")
    if numbered.isEmpty():
        return False
    _writer(numbered.select(F.col("_id").alias("id"), F.col("texto").alias(TEXT_COLUMN))).csv(path)
    return True


def write_raw_texts_by_keyword(df: DataFrame, path: str, *order: str) -> bool:
    """As ``write_raw_texts`` for many searches: one folder, and ids from 1, per ``keyword``."""
    numbered = with_row_ids_within(df, "keyword", *order, name="_id").select(
        F.col("_id").alias("id"), F.col("texto").alias(TEXT_COLUMN), "keyword"
    )
    if numbered.isEmpty():
        return False
    _writer(numbered).partitionBy("keyword").csv(path)
    return True


def results_layout(df: DataFrame) -> DataFrame:
    """Columns of the results file: the text under its file name, the lexicon label if present."""
    optional = [LEXICON_LABEL] if LEXICON_LABEL in df.columns else []
    return df.select("id", "origem", F.col("texto").alias(TEXT_COLUMN), MODEL_LABEL, *optional)


def write_results(df: DataFrame, path: str, *order: str) -> bool:
    """Write classified rows with dense ids in ``order``; nothing for an empty table."""
    numbered = with_row_ids(df, *order, name="_id").drop("id").withColumnRenamed("_id", "id")
    if numbered.isEmpty():
        return False
    _writer(results_layout(numbered)).csv(path)
    return True


def raw_output_name(keyword: str) -> str:
    return RAW_NAME.format(keyword=checked_keyword(keyword))


def results_output_name(keyword: str) -> str:
    return RESULTS_NAME.format(keyword=checked_keyword(keyword))


def file_results_name(path: str) -> str:
    """Results name for an input file."""
    return posixpath.basename(path).replace(".csv", FILE_RESULTS_SUFFIX)
