"""Posts with comments as rows of text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinaria.operators.summary import cleaned_rows
from opinaria.sources.scratch import materialise

# Posts per search, comments per post, origin names.
POST_LIMIT = 8
COMMENT_LIMIT = 5
TITLE = "titulo"
COMMENT = "comentario"
MANUAL = "manual"


def checked_keyword(keyword: str) -> str:
    """The trimmed keyword; an empty one is an error."""
    trimmed = (keyword or "").strip()
    if not trimmed:
        raise ValueError("the keyword is empty")
    return trimmed


def has_title(title: Column) -> Column:
    return title.isNotNull() & (title != "")


def find_posts(posts: DataFrame, keyword: str, limit: int = POST_LIMIT) -> DataFrame:
    """The first posts, by id, whose title holds the keyword in any case."""
    word = checked_keyword(keyword).lower()
    return posts.filter(F.lower("title").contains(word)).orderBy("post_id").limit(limit)


def first_comments(comments: DataFrame, limit: int = COMMENT_LIMIT) -> DataFrame:
    """The first comments of every post in position order.

    Spark keeps only the first ``limit`` rows per post in each task before it shuffles, so a post
    with a third of all comments costs no more than any other.
    """
    in_order = Window.partitionBy("post_id").orderBy("pos")
    ranked = comments.withColumn("_rank", F.row_number().over(in_order))
    return ranked.filter(F.col("_rank") <= limit).drop("_rank")


def as_texts(titles: DataFrame, comments: DataFrame) -> DataFrame:
    """(post_id, pos, origem, texto) of titles and chosen comments, cleaned; empty texts go."""
    title_rows = cleaned_rows(
        titles.filter(has_title(F.col("title"))), F.col("title"),
        "post_id", F.lit(0).cast("bigint").alias("pos"), F.lit(TITLE).alias("origem"),
    )
    comment_rows = cleaned_rows(
        comments, F.col("body"),
        "post_id", F.col("pos").cast("bigint").alias("pos"), F.lit(COMMENT).alias("origem"),
    )
    return title_rows.unionByName(comment_rows)


def texts_of_posts(
    posts: DataFrame, comments: DataFrame, comment_limit: int = COMMENT_LIMIT
) -> DataFrame:
    """(post_id, pos, origem, texto): the title and the first comments of every post.

    Takes flat tables: posts (post_id, title) and comments (post_id, pos, body).
    """
    return as_texts(posts, first_comments(comments, comment_limit))


def collect_texts(
    posts: DataFrame, comments: DataFrame, keyword: str,
    post_limit: int = POST_LIMIT, comment_limit: int = COMMENT_LIMIT,
) -> DataFrame:
    """Keyword search: titles and first comments of the first matching posts."""
    found = find_posts(posts.select("post_id", "title"), keyword, post_limit)
    # At most post_limit ids are broadcast, and comments of other posts are dropped in the scan task.
    ids = F.broadcast(found.select("post_id"))
    return texts_of_posts(found, comments.join(ids, "post_id", "left_semi"), comment_limit)


def collect_ranked_texts(
    posts: DataFrame, comments: DataFrame, index: str, keywords: Sequence[str],
    post_limit: int = POST_LIMIT, comment_limit: int = COMMENT_LIMIT,
) -> DataFrame:
    """(keyword, rank, post_id, pos, origem, texto): the posts that an index of titles ranks first for each keyword.

    A post that several keywords find is read once and given to each.
    """
    from opinaria.operators.search import search

    found = materialise(search(posts.sparkSession, index, keywords, post_limit), "found-posts")
    # At most post_limit ids per keyword.
    ids = F.broadcast(found.select("post_id").distinct())
    texts = texts_of_posts(
        posts.join(ids, "post_id", "left_semi"), comments.join(ids, "post_id", "left_semi"), comment_limit)
    named = F.broadcast(found.select("keyword", F.col("rank").cast("long").alias("rank"), "post_id"))
    return texts.join(named, "post_id").select("keyword", "rank", "post_id", "pos", "origem", "texto")


def texts_of_nested_posts(posts: DataFrame, comment_limit: int = COMMENT_LIMIT) -> DataFrame:
    """As ``texts_of_posts`` for posts that carry ``comments array<struct<pos,body>>``; no shuffle.

    A post whose comments are null gives its title only.
    """
    first = F.slice(F.array_sort("comments"), 1, comment_limit)
    comments = posts.select("post_id", F.inline(first))
    return as_texts(posts.select("post_id", "title"), comments)


def collect_nested_texts(
    posts: DataFrame, keyword: str,
    post_limit: int = POST_LIMIT, comment_limit: int = COMMENT_LIMIT,
) -> DataFrame:
    """Keyword search over posts that carry their comments."""
    return texts_of_nested_posts(find_posts(posts, keyword, post_limit), comment_limit)
