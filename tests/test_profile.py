"""Profiles kept per batch and merged."""

import datetime

import pytest

from opinaria.operators import profile

KINDS = "a string, `b.c` int, d double, e date, columns string"
ROWS = [
    ("x", 1, 0.5, datetime.date(2020, 1, 1), "p"), ("x", None, None, None, None), (None, 2, 0.5, None, "q"),
    ("y", 1, 1.5, datetime.date(2020, 1, 1), "p"), ("y", 1, 1.5, datetime.date(2020, 1, 1), "p"),
]


def plain(rows):
    out = []
    for i, kind in enumerate(KINDS.split(", ")):
        name, type_ = kind.replace("`", "").split(" ")
        values = [r[i] for r in rows if r[i] is not None]
        out.append((name, type_, len(rows), len(values), len(set(values))))
    return sorted(out)


def merged(df):
    return sorted(map(tuple, profile.merged_profile(df).collect()))


def test_one_pass_and_merged_batches_agree(spark, tmp_path):
    path = str(tmp_path / "profile")
    for i in range(0, len(ROWS), 2):
        profile.keep_profile(spark.createDataFrame(ROWS[i:i + 2], KINDS), path, str(i))
    assert merged(profile.kept_profile(spark, path)) == plain(ROWS)
    assert merged(profile.sketched(spark.createDataFrame(ROWS, KINDS))) == plain(ROWS)


def test_a_batch_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "profile")
    for _ in range(2):
        profile.keep_profile(spark.createDataFrame(ROWS, KINDS), path, "one")
    assert merged(profile.kept_profile(spark, path)) == plain(ROWS)


def test_groups_are_parts_of_the_whole(spark):
    df = spark.createDataFrame(ROWS, KINDS)
    by_group = profile.sketched(df, "a")
    assert by_group.count() == 3
    assert merged(by_group) == [row for row in plain(ROWS) if row[0] != "a"]


def test_empty_table(spark):
    df = spark.createDataFrame([], KINDS)
    assert merged(profile.sketched(df)) == plain([])
    assert profile.sketched(df, "a").count() == 0


@pytest.mark.parametrize("size", [1 << profile.SKETCH_BITS, 1 << (profile.SKETCH_BITS + 4)])
def test_distinct_counts_keep_their_error(spark, size):
    """Exact up to the size of the sketch, then within 1.6 % in most cases: twice that is asked for here."""
    df = spark.range(3 * size).selectExpr(f"id % {size} AS v", "id % 7 AS part")
    got = profile.merged_profile(profile.sketched(df, "part")).first()
    assert got["rows"] == 3 * size
    error = abs(got["distinct"] - size) / size
    assert error == 0 if size <= 1 << profile.SKETCH_BITS else error < 0.032
