"""The most frequent terms by bounded summaries against a count of all terms."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from opinaria.operators import heavy_terms as ht


def counted(rows):
    return Counter(w for _, words in rows for w in words or () if len(w) >= 2)


def first(rows, k):
    return sorted(counted(rows).items(), key=lambda x: (-x[1], x[0]))[:k]


def zipf(n, vocabulary, exponent, seed=3):
    rnd = random.Random(seed)
    terms = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) ** exponent for i in range(vocabulary)]
    rows = [(i, rnd.choices(terms, weights, k=rnd.randrange(40))) for i in range(n)]
    return [*rows, (n, None), (n + 1, []), (n + 2, ["x", "é", "日本", "w0"])]


@pytest.fixture
def full_counts(monkeypatch):
    """How often all terms were counted."""
    calls, plain = [], ht.term_frequencies
    monkeypatch.setattr(ht, "term_frequencies", lambda *a: calls.append(1) or plain(*a))
    return calls


def heavy(spark, rows, k, parts=4, **options):
    df = spark.createDataFrame(rows, "id bigint, words array<string>").repartition(parts)
    return [tuple(r) for r in ht.heavy_terms(df, k, **options).collect()]


@pytest.mark.parametrize("capacity", [150, 400, 100_000])
def test_separated_terms_are_not_counted_in_full(spark, full_counts, capacity):
    rows = zipf(1500, 1200, 1.4)
    assert heavy(spark, rows, 10, capacity=capacity) == first(rows, 10)
    assert not full_counts


def test_flat_counts_fall_back(spark, full_counts):
    rows = zipf(600, 500, 0.0)
    assert heavy(spark, rows, 20, capacity=30) == first(rows, 20)
    assert full_counts


def test_too_many_candidates_fall_back(spark, full_counts):
    rows = zipf(1500, 1200, 1.4)
    # Ten terms are always candidates for ten places.
    assert heavy(spark, rows, 10, capacity=150, max_candidates=9) == first(rows, 10)
    assert full_counts


def test_ties_at_the_last_place(spark, full_counts):
    """Forty terms share the kth count, among rare ones that make every task drop counts."""
    rows = [(i, [f"top{j}" for j in range(5)] + [f"tie{j:02}" for j in range(40)] + [f"rare{i}"]) for i in range(400)]
    rows += [(1000, [f"top{j}" for j in range(5)])]
    assert heavy(spark, rows, 17, capacity=60) == first(rows, 17)
    assert not full_counts


def test_fewer_terms_than_asked_for_and_none(spark):
    assert heavy(spark, [(1, ["aa", "bb", "aa", "c"])], 5) == [("aa", 2), ("bb", 1)]
    assert heavy(spark, [(1, None), (2, [])], 5) == []
    rows = zipf(50, 20, 1.0)
    assert heavy(spark, rows, 100, capacity=5) == first(rows, 100)


def test_bounds_hold_for_every_term(spark):
    rows = zipf(1500, 1200, 1.0)
    df = spark.createDataFrame(rows, "id bigint, words array<string>").repartition(5)
    got = ht.summaries(df, capacity=100).collect()
    error, low = sum(r["error"] or 0 for r in got), Counter()
    for r in got:
        if r["term"] is not None:
            low[r["term"]] += r["low"]
    assert error > 0
    for term, n in counted(rows).items():
        assert low[term] <= n <= low[term] + error


def test_cut_keeps_the_greatest():
    table = pa.table({"term": ["a", "b", "c", "d"], "low": pa.array([5, 2, 2, 9], pa.int64())})
    kept, off = ht.cut_to(table, 2)
    assert (sorted(kept["term"].to_pylist()), sorted(kept["low"].to_pylist()), off) == (["a", "d"], [3, 7], 2)
    assert ht.cut_to(table, 4) == (table, 0)
