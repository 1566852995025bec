"""Whitening and top-k search against numpy on whole small tables."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from opinaria.llm import spectral, topk, whitening
from opinaria.llm.vectors import integer_vectors, matrices

SF = "/root/testdata/sf0.001/embeddings.parquet"
NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, x string, _id int, width int, score int, n int, rank int"


def table(spark, rows):
    """Columns whose names occur inside the operators ride along."""
    return spark.createDataFrame([(i, v, "x", 1, 2, 3, 4, 5) for i, v in rows], SCHEMA).repartition(3)


def integers(rows):
    return [(i, [math.floor(256 * c) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def drawn(seed, n, width, scale=0.2):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(0.3, scale, width).tolist()) for i in range(n)]


def brute_whitened(rows, k=4):
    """{width: (n, sums, values, axes, trace)} by numpy's own eigenvectors."""
    models = {}
    for width in {len(x) for _, x in rows}:
        distinct = sorted({tuple(v) for _, v in rows if len(v) == width})
        x = np.array(distinct, dtype=np.int64).reshape(len(distinct), width)
        n, sums = len(x), x.sum(axis=0)
        y = x - sums / n
        v = y.T @ y / n
        values, axes = np.linalg.eigh(v)
        models[width] = n, sums, values[::-1][:k], axes[:, ::-1][:, :k], np.trace(v)
    return models


def assert_whitened(got, rows, k=4):
    models = brute_whitened(rows, k)
    signs = {}
    expected = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    found = {}
    for r in got:
        found.setdefault((r["_id"], r["deviation"], r["n"]), []).append(r)
    assert len(got) == len(expected)
    for i, x in expected:
        n, sums, values, axes, trace = models[len(x)]
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        r = found[i, deviation, n].pop()
        z = (np.array(x) - sums / n) @ axes / np.sqrt(np.maximum(values, 1e-300))
        own = np.array(r["whitened"])
        sign = signs.setdefault(len(x), np.ones(len(own)))
        for c in range(len(own)):
            if abs(own[c]) > 1e-6 and sign[c] == 1 and abs(own[c] + z[c]) < 1e-8:
                sign[c] = -1
        assert np.allclose(own * sign, z[: len(own)], atol=1e-8)
        assert np.allclose(r["explained"], values[: len(own)] / trace if len(own) else [], rtol=1e-10)
        assert r["identity_error"] < 1e-10


@pytest.mark.parametrize("kind", ["spread", "repeated", "identity", "deficient"])
@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_leading_equals_eigh(kind, size):
    rng = np.random.default_rng(size)
    q, _ = np.linalg.qr(rng.normal(size=(size, size)))
    at = np.arange(size)
    values = {"spread": rng.uniform(1, 9, size), "repeated": np.where(at % 2, 5.0, 7.0),
              "identity": np.full(size, 3.0), "deficient": np.where(at < 3, 2.0 + at, 0.0)}[kind]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, axes = spectral.leading(a, 4)
    expected = np.sort(values)[::-1][:4]
    expected = expected[expected > 0]
    assert np.allclose(found, expected, rtol=1e-12)
    assert np.allclose(axes.T @ axes, np.eye(len(found)), atol=1e-13)
    assert np.allclose(a @ axes, axes * found, atol=1e-12)


def test_polar_factor_is_orthogonal():
    a = np.random.default_rng(3).normal(size=(12, 12))
    u = spectral.polar_factor(a + a.T)
    h = u.T @ (a + a.T)
    assert np.allclose(u.T @ u, np.eye(12), atol=1e-13) and np.linalg.eigvalsh((h + h.T) / 2).min() > 0


def test_whitening_equals_numpy(spark):
    rows = drawn(1, 90, 6) + [(200 + i, v) for i, v in drawn(1, 90, 6)[:40]]
    rows += [(None, rows[0][1]), (7, rows[1][1]), (7, rows[2][1])]
    odd = [(300, None), (301, [None, *rows[0][1][1:]]), (302, [NAN, *rows[0][1][1:]]), (303, [INF, *rows[0][1][1:]])]
    got = whitening.whiten(table(spark, rows + odd)).collect()
    assert_whitened(got, integers(rows))


def test_whitening_far_from_zero(spark):
    """A mean of a million times the deviation costs no digit, as the products are centred."""
    rows = [(i, [4e6 + a for a in v]) for i, v in drawn(2, 60, 4, 1.0)]
    assert_whitened(whitening.whiten(table(spark, rows)).collect(), integers(rows))


def test_whitening_of_each_width_and_of_flat_ones(spark):
    rows = drawn(3, 30, 3) + [(100 + i, v) for i, v in drawn(4, 30, 5)] + [(200, []), (201, []), (202, [0.5] * 8), (203, [0.5] * 8)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert_whitened(got, integers(rows))
    flat = [r for r in got if r["_id"] >= 200]
    assert len(flat) == 4 and all(r["whitened"] == [] and r["deviation"] == 0 for r in flat)


def test_whitening_query_and_empty_table(spark):
    whole = spark.read.parquet(SF)
    got = whitening.query(whole).collect()
    assert len(got) == 4 * whole.count() and {r["component"] for r in got} == {1, 2, 3, 4}
    assert [t for _, t in whitening.query(whole).dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    assert whitening.query(whole.filter("false")).collect() == []
    assert whitening.query(table(spark, [(1, None), (2, [NAN])])).collect() == []


def test_deviation_beyond_64_bits_is_an_error(spark):
    rows = [(0, [1e6]), (1, [-1e6]), (2, [0.0])]
    model = whitening.Whitening(3, (0,), np.ones(1), np.eye(1), 1.0)
    with pytest.raises(OverflowError):
        model.deviations(np.array([[1 << 40]]))
    got = {r["_id"]: r["deviation"] for r in whitening.whiten(table(spark, rows)).collect()}
    assert got == {0: 768_000_000**2, 1: 768_000_000**2, 2: 0}


def test_packing_round_trip(spark):
    rows = [(1, [0.5, -0.25]), (2, [200.0, 1.0]), (3, [-128.0, 127.999]), (4, [3.0]), (5, [])]
    packed = integer_vectors(table(spark, rows), "vec_id", "embedding").toArrow().to_batches()
    found = {int(i): x.tolist() for b in packed for _, at, m in matrices(b) for i, x in zip(np.asarray(b["_id"])[at], m, strict=True)}
    assert found == dict(integers(rows))


def brute_search(rows, is_query, k):
    """The queries' results as sorted rows; rows of one query id are several queries."""
    usable = [(i, x) for i, x in integers(rows) if i is not None]
    out = []
    for i, q in usable:
        if is_query(i):
            scored = [(-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in usable if j != i and len(x) == len(q)]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def searched(spark, rows, k=5, every=5, **options):
    got = topk.search(table(spark, rows), F.col("_id") % every == 0, k=k, **options)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())


@pytest.mark.parametrize("k,block", [(1, 100), (5, 3), (7, 4096)])
def test_search_equals_brute_force(spark, k, block):
    same = [(100 + i, [0.25, -0.5, 0.125]) for i in range(40)]
    rows = drawn(5, 70, 3) + same + [(None, [9.0, 9.0, 9.0]), (141, None), (145, [NAN, 0.0, 0.0]), (146, [None, 0.0, 0.0])]
    assert searched(spark, rows, k, query_block=block) == brute_search(rows, lambda i: i % 5 == 0, k)


def test_search_over_widths_repeated_ids_and_few_rows(spark):
    rows = drawn(6, 12, 2) + [(20, [1.0]), (21, [2.0]), (25, []), (30, []), (5, [0.1, 0.9]), (7, [0.5, 0.5]), (7, [0.5, 0.5])]
    assert searched(spark, rows) == brute_search(rows, lambda i: i % 5 == 0, 5)
    assert searched(spark, [(0, [1.0])]) == [] and searched(spark, [(1, [1.0])]) == [] and searched(spark, [(0, None)]) == []


def test_search_of_scores_beyond_doubles(spark):
    rows = [(i, [float(v), float(-v)]) for i, v in enumerate((3_000_000, 2_999_999, -3_000_000, 17, 5_000_000, 4_999_999))]
    assert searched(spark, rows, k=3) == brute_search(rows, lambda i: i % 5 == 0, 3)
    with pytest.raises(Exception, match="64 bits"):
        searched(spark, [(0, [1e9]), (1, [1e9])])


def test_query_equals_sql(spark):
    whole = spark.read.parquet(SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}'")
    result = con.execute(topk.ORACLE_SQL)
    names = [d[0] for d in result.description]
    got = topk.query(whole)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(result.fetchall())
    assert topk.query(whole.filter("false")).collect() == []
