"""Phrase mining against a plain count of all phrases, and against its SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from opinaria.llm import phrases

SF = "/root/testdata/sf0.001/documents.parquet"
PIECE, WORD = re.compile("[.,;:!?\x0a-\x0d]"), re.compile("[^\x20\x09]+")
SCHEMA = "doc_id long, text string, lang string, phrase string, n int, key int, size int"


def brute(rows, plan):
    """Rows as ``mine`` gives them, from (text, lang)."""
    found = defaultdict(Counter)
    for text, lang in rows:
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in PIECE.split(folded):
            words = WORD.findall(piece)
            for size in range(1, plan.most + 1):
                found["und" if lang is None else lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in found.items():
        chosen = {p: a for p, a in counts.items() if plan.least <= len(p) and a >= plan.support}
        kept = []
        for p, a in chosen.items():
            inside = any(len(q) > len(p) and 100 * b >= plan.part_of_100 * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                         for q, b in chosen.items())
            if not inside:
                score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                            for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        n = sum(c for p, c in counts.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -score)
                for i, (score, a, p, left, right) in enumerate(sorted(kept)[: plan.top])]
    return sorted(out)


def mined(spark, rows, plan):
    made = [(i, t, lang, "p", 1, 2, 3) for i, (t, lang) in enumerate(rows)]
    made = [(None if i % 4 == 0 else i // 2, *r) for i, *r in made]
    return sorted(map(tuple, phrases.mine(spark.createDataFrame(made, SCHEMA).repartition(3), plan).collect()))


TEXTS = [
    "The cat sat. The cat sat! the cat\tran, the  dog ran", "THE CAT SAT\nthe cat sat", "a a a a a a b", "É É é é É É", "",
    None, "   \t ", "...!?", "one\x0btwo\x0ctwo\rone two one two", "x y x y x\x1fy x\x1fy", "the cat ran the dog sat the cat ran",
    "한국 어 한국 어 한국 어", "\U0001f600 ￮ \U0001f600 ￮", "a\x00b a\x00b c",
]


@pytest.mark.parametrize("plan", [
    phrases.Mining(support=2, filter_bits=16), phrases.Mining(support=3, most=5, part_of_100=80, filter_bits=20),
    phrases.Mining(support=1, most=2, top=3, shards=1, filter_bits=12), phrases.Mining(least=3, most=4, support=2, shards=7, filter_bits=16)])
def test_mining_equals_brute_force(spark, plan):
    rows = [(t, ("en", "de", None, "und")[i % 4]) for i, t in enumerate(TEXTS * 3)]
    got = mined(spark, rows, plan)
    assert got == brute(rows, plan) and got


def test_a_full_bitmap_changes_nothing(spark):
    rows = [(f"w{i % 7} w{i % 5} w{i % 3} w{i % 11}. w{i % 2} w{i % 13}", "en") for i in range(300)]
    plan = phrases.Mining(support=4, filter_bits=6)
    assert mined(spark, rows, plan) == brute(rows, plan)


def test_long_text_is_cut_at_pieces(spark, monkeypatch):
    text = " ".join(f"w{i % 17} w{i % 4}{'.' if i % 9 == 0 else ''}" for i in range(4000))
    assert b"".join(phrases._cut(text.encode(), 100)) == text.encode()
    assert all(p.startswith(b".") for p in list(phrases._cut(text.encode(), 100))[1:])
    batch = pa.RecordBatch.from_pydict({"_text": [text], "_lang": ["en"], "_shard": [0]})
    parts = list(phrases.slices(iter([batch]), 1000))
    assert len(parts) > 20 and max(sum(map(len, p)) for p, _ in parts) < 1200
    plan = phrases.Mining(support=5, filter_bits=16)
    assert mined(spark, [(text, "en"), ("no break " * 500, "en")], plan) == brute([(text, "en"), ("no break " * 500, "en")], plan)


def test_ties_and_products_beyond_64_bits(spark):
    counts = spark.createDataFrame(
        [("en", "a", 1, 4 * 10**12), ("en", "b", 1, 5 * 10**12), ("en", "c", 1, 4 * 10**12), ("en", "a b", 2, 3 * 10**12),
         ("en", "b c", 2, 3 * 10**12), ("en", "a b c", 3, 2 * 10**12)], "lang string, phrase string, size int, n long")
    got = {r["phrase"]: (r["l"], r["r"], r["score"]) for r in phrases.cut_scores(counts, phrases.Mining()).collect()}
    assert got["a b"] == (4 * 10**12, 5 * 10**12, 450_000)
    # Both cuts score 333,333; the first counts.
    assert got["a b c"] == (4 * 10**12, 3 * 10**12, 333_333)


def test_query_equals_sql_and_empty_table(spark):
    whole = spark.read.parquet(SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}'")
    result = con.execute(phrases.ORACLE_SQL)
    names = [d[0] for d in result.description]
    assert sorted(tuple(r[c] for c in names) for r in phrases.query(whole).collect()) == sorted(result.fetchall())
    assert phrases.query(whole.filter("false")).collect() == []
    assert phrases.query(whole.selectExpr("doc_id", "CAST(NULL AS string) AS text", "lang")).collect() == []
