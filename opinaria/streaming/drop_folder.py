"""Classify comment files as they arrive in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from opinaria.operators.summary import label_counts
from opinaria.sources.files import TEXT_COLUMN, csv_options, manual_texts

RAW_SCHEMA = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField(TEXT_COLUMN, T.StringType())]
)


def stream_texts(
    spark: SparkSession, folder: str, schema: T.StructType = RAW_SCHEMA,
    text_column: str = TEXT_COLUMN, *, multi_line: bool = True, max_files: int | None = None,
) -> DataFrame:
    """(origem, texto) of every comment file in the folder, now and later.

    ``max_files`` bounds how many files one micro-batch takes. A file whose header differs from
    ``schema`` is an error: no column is taken for another by its place.
    """
    options = csv_options(multi_line=multi_line)
    reader = spark.readStream.schema(schema).options(**options, enforceSchema=False)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return manual_texts(reader.csv(folder), text_column)


def classify_folder(
    texts: DataFrame, classify: Callable[[DataFrame], DataFrame], target: str, checkpoint: str
) -> StreamingQuery:
    """Append classified rows to a Parquet folder: all files present, then stop.

    The checkpoint remembers the files done, so the next run takes only new ones.
    """
    return (
        classify(texts).writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def count_labels(texts: DataFrame, label: str, target: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of running label counts: the state is one row per label.

    Each micro-batch replaces the table by the complete counts.
    """

    def replace(batch: DataFrame, _batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(target)

    # Complete mode is the one mode in which a stream may be sorted, so the batch report serves here.
    return (
        label_counts(texts, label).writeStream.outputMode("complete").foreachBatch(replace)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def keep_counts(texts: DataFrame, label: str, target: str, checkpoint: str) -> StreamingQuery:
    """Keep running label counts as one folder per micro-batch, for readers that come at any time.

    A folder appears by the rename of its one file and is never changed by a later batch, so that
    ``read_counts`` sees the complete counts of some batch at every moment. A batch that is played again
    after a failure writes its own folder anew, with the same rows.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        label_counts(texts, label).writeStream.outputMode("complete").foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_counts(spark: SparkSession, target: str, batch: int | None = None) -> DataFrame:
    """(label, n) after the newest micro-batch, or after the named one."""
    kept = spark.read.schema("label string, n long, batch long").option("basePath", target).parquet(target)
    if batch is None:
        # The batch is a folder name: its greatest value needs one number per file.
        batch = kept.agg(F.max("batch").alias("batch")).first()["batch"]
    return kept.filter(F.col("batch") == F.lit(batch)).select("label", "n")
