"""Comments that answer comments: a forest per post, flattened breadth-first.

A comment names its parent. Every comment's path from the root of its tree is found by pointer doubling:
a round joins each unfinished comment with the one it points at and takes over that one's path and
pointer, so a tree of depth d takes log2(d) rounds, whatever the number of posts. Breadth-first order is
then the order of (depth, path), without a walk over any post.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinaria.sources.posts import COMMENT_LIMIT, as_texts
from opinaria.sources.scratch import materialise

KEYS = ("post_id", "comment_id")


def paths(comments: DataFrame) -> DataFrame:
    """(post_id, comment_id, path): the (pos, comment_id) of every ancestor from the root on, and its own.

    Takes (post_id, comment_id, parent_id, pos); ids are unique within a post. A null parent, or one that
    the post does not have, makes a root. Comments on a cycle, or below one, have no root: their path is
    null. A path is as long as its comment is deep.
    """
    links = materialise(comments.select(*KEYS, "parent_id", "pos"), "forest-links")
    if not links.groupBy(*KEYS).count().filter("count > 1").isEmpty():
        raise ValueError("comment ids repeat within a post")
    present = links.select("post_id", F.col("comment_id").alias("parent_id"), F.col("comment_id").alias("up"))
    own = F.array(F.struct("pos", "comment_id")).alias("path")
    state = materialise(links.join(present, ["post_id", "parent_id"], "left").select(*KEYS, "up", own), "forest-paths")
    done = []
    while True:
        done.append(state.filter("up IS NULL").drop("up"))
        rest = state.filter("up IS NOT NULL")
        if rest.isEmpty():
            break
        finished = [d.withColumn("up", F.lit(None).cast(state.schema["up"].dataType)) for d in done]
        above = _union([rest, *finished]).select(
            "post_id", F.col("comment_id").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        state = materialise(rest.join(above, ["post_id", "up"]).select(
            *KEYS, F.col("next").alias("up"), F.concat("head", "path").alias("path")), "forest-paths")
        # With a finite path left, this round would have finished one: what remains runs in circles.
        if state.filter("up IS NULL").isEmpty():
            done.append(rest.select(*KEYS, F.lit(None).cast(state.schema["path"].dataType).alias("path")))
            break
    return _union(done)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def with_depth(comments: DataFrame) -> DataFrame:
    """The comments with ``depth`` (a root has 1) and ``path``; both null for those on or below a cycle."""
    return comments.join(paths(comments), list(KEYS)).withColumn("depth", F.when(F.col("path").isNotNull(), F.size("path")))


def first_in_breadth(placed: DataFrame, limit: int | None = COMMENT_LIMIT) -> DataFrame:
    """Every post's comments in breadth-first order, numbered from 1 as ``place``; the first ``limit`` or all.

    With a limit Spark keeps that many rows per post in each task before it shuffles.
    """
    order = Window.partitionBy("post_id").orderBy("depth", "path")
    ranked = placed.filter("path IS NOT NULL").withColumn("place", F.row_number().over(order))
    return ranked if limit is None else ranked.filter(F.col("place") <= limit)


def texts_of_forest(posts: DataFrame, comments: DataFrame, limit: int = COMMENT_LIMIT) -> DataFrame:
    """(post_id, pos, origem, texto): the title and the first comments of every post, replies after what they answer.

    Takes posts (post_id, title) and comments (post_id, comment_id, parent_id, pos, body).
    """
    first = first_in_breadth(with_depth(comments), limit)
    return as_texts(posts, first.select("post_id", F.col("place").alias("pos"), "body"))
