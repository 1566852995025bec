"""Ranked keyword search: an inverted index written once, and BM25 scores by joins with it.

A posting carries its document's length, so a search reads postings only: those of the asked terms,
joined with a small table of weights and summed per document. The index is sorted by term, so files and
row groups without an asked term are skipped, and a frequent term's postings fill many files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinaria.functions.text import tokens
from opinaria.sources.posts import checked_keyword

# The usual saturation and length weight of BM25.
K1, B = 1.2, 0.75
SCORE_DIGITS = 6
# Terms of all keywords of one search; they are broadcast.
MOST_TERMS = 1000
POSTINGS, TERMS, SIZES = "postings", "terms", "sizes"


def write_index(texts: DataFrame, path: str, key: str = "post_id", text: str = "title") -> None:
    """Postings (term, key, n, length), terms (term, n_texts) and sizes (n_texts, n_words) below ``path``.

    Texts without words are not indexed. Keys are unique.
    """
    words = texts.select(key, tokens(F.col(text)).alias("words")).withColumn("length", F.size("words"))
    rows = words.select(key, "length", F.explode("words").alias("term"))
    # A text's words lie in its own row, so the partial counts of a task are final already.
    postings = rows.groupBy(key, "length", "term").agg(F.count("*").alias("n"))
    postings.repartitionByRange("term", key).sortWithinPartitions("term", key).write.parquet(f"{path}/{POSTINGS}")
    written = texts.sparkSession.read.parquet(f"{path}/{POSTINGS}")
    written.groupBy("term").agg(F.count("*").alias("n_texts")).repartitionByRange("term").sortWithinPartitions(
        "term").write.parquet(f"{path}/{TERMS}")
    sizes = written.groupBy(key).agg(F.first("length").cast("long").alias("length")).agg(
        F.count("*").alias("n_texts"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_words"))
    sizes.write.parquet(f"{path}/{SIZES}")


def _asked(spark: SparkSession, keywords: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(keyword, term) once for each term of a keyword, and all terms."""
    given = spark.createDataFrame([(k, checked_keyword(k)) for k in keywords], "keyword string, text string")
    pairs = given.select("keyword", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    # As many rows as the caller's keywords have words.
    rows = pairs.limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    if {r["keyword"] for r in rows} != set(keywords):
        raise ValueError("a keyword has no word")
    return spark.createDataFrame([tuple(r) for r in rows], "keyword string, term string"), sorted({r["term"] for r in rows})


def search(
    spark: SparkSession, path: str, keywords: Sequence[str], limit: int, key: str = "post_id",
    k1: float = K1, b: float = B,
) -> DataFrame:
    """(keyword, rank, key, score): the best texts of each keyword; equal scores by key.

    A text needs one of the keyword's words. The score of a word that n of N texts have is
    ln(1 + (N - n + 0.5) / (n + 0.5)) f (k1 + 1) / (f + k1 (1 - b + b length / mean length)).
    """
    asked, terms = _asked(spark, keywords)
    sizes = spark.read.parquet(f"{path}/{SIZES}").first()
    n_texts, mean = sizes["n_texts"], sizes["n_words"] / max(1, sizes["n_texts"])
    spread = F.col("n_texts").cast("double")
    idf = F.log1p((F.lit(float(n_texts)) - spread + 0.5) / (spread + 0.5))
    weights = spark.read.parquet(f"{path}/{TERMS}").filter(F.col("term").isin(terms)).join(
        F.broadcast(asked), "term").select("keyword", "term", idf.alias("idf"))
    hits = spark.read.parquet(f"{path}/{POSTINGS}").filter(F.col("term").isin(terms)).join(F.broadcast(weights), "term")
    part = F.col("idf") * F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("length") / F.lit(max(mean, 1e-9))))
    scored = hits.groupBy("keyword", key).agg(F.round(F.sum(part), SCORE_DIGITS).alias("score"))
    order = Window.partitionBy("keyword").orderBy(F.desc("score"), key)
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select("keyword", "rank", key, "score")
