"""Byte and word deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opinaria.llm import arrays as A
from opinaria.llm import debruijn, suffixes
from opinaria.llm import windows as W


def brute(docs, split, window, by_place):
    """doc -> set of removed positions; docs: (id, text) in any order."""
    first, gone = {}, {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        units = split(text or "")
        for p in range(len(units) - window + 1):
            place = (doc, p) if by_place else (doc,)
            if first.setdefault(tuple(units[p : p + window]), place) < place:
                gone.setdefault(doc, set()).update(range(p, p + window))
    return gone


def made_texts(seed, words=40):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "é", "and", "inter", "tion", "x", "日本語", "foo,", "Bar."]
    passage = [rnd.choice(vocabulary) + str(rnd.randrange(60)) for _ in range(90)]
    whole = [rnd.choice(vocabulary) + str(rnd.randrange(60)) for _ in range(140)]
    texts = []
    for i in range(words):
        body = [rnd.choice(vocabulary) + str(rnd.randrange(60)) for _ in range(rnd.choice((3, 30, 200)))]
        kind = i % 6
        if kind == 0:
            cut = rnd.randrange(len(body))
            body[cut:cut] = passage[rnd.randrange(20) : 90 - rnd.randrange(20)]
        elif kind == 1:
            body = list(whole)
        elif kind == 2:
            body = list(whole)
            body[rnd.randrange(len(body))] = "edited"
        elif kind == 3:
            body = body + body
        texts.append((" " if i % 5 else "\n").join(body))
    return [*enumerate(texts), (900, None), (901, ""), (902, "a" * 400), (903, "a" * 260), (904, "é " * 200), (905, "é " * 80)]


@pytest.mark.parametrize("seed", range(3))
def test_bytes_like_brute_force(texts, seed):
    rows = made_texts(seed)
    got = {r["doc_id"]: r for r in suffixes.query(texts(rows)).collect()}
    gone = brute(rows, lambda t: t.encode(), 100, True)
    assert len(got) == len(rows) and gone
    for doc, text in rows:
        data, removed = (text or "").encode(), gone.get(doc, set())
        kept = bytes(b for i, b in enumerate(data) if i not in removed)
        spans = sum(1 for i in removed if i - 1 not in removed)
        assert tuple(got[doc]) == (doc, len(data), len(removed), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("seed", range(3))
def test_words_like_brute_force(texts, seed):
    rows = made_texts(seed)
    got = {r["doc_id"]: r for r in debruijn.query(texts(rows)).collect()}
    gone = brute(rows, lambda t: t.encode().split(), 50, False)
    assert len(got) == len(rows) and gone
    for doc, text in rows:
        words, removed = (text or "").encode().split(), gone.get(doc, set())
        kept = b" ".join(w for i, w in enumerate(words) if i not in removed)
        assert tuple(got[doc]) == (doc, len(words), len(removed), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("remove", [suffixes.remove_repeated_bytes, debruijn.remove_repeated_words])
def test_null_ids_repeated_rows_and_clashing_columns(spark, remove):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text, 1, "x"), (5, text, 2, None), (5, text, 2, None), (9, text, None, "y"), (10, "short", 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, h string")
    out = [(r["row"]["doc_id"], r["row"]["_id"], r["row"]["h"], r["cut"]["n_removed"]) for r in remove(df).collect()]
    whole = len(text.encode()) if remove is suffixes.remove_repeated_bytes else 80
    assert sorted(out, key=str) == sorted(
        [(None, 1, "x", 0), (5, 2, None, 0), (5, 2, None, 0), (9, None, "y", whole), (10, 3, "z", 0)], key=str)
    assert remove(df.filter("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), min_size=1, max_size=5), st.integers(1, 6), st.integers(0, 9))
def test_choose_depends_on_the_window_alone(docs, k, more):
    window = k + more
    lengths = np.array([len(d) for d in docs])
    flat = np.array([x for d in docs for x in d], dtype=np.uint64)
    got = A.choose(A.Rolling(A.mix(flat + np.uint64(1))), lengths, k, window)
    chosen = {}
    for doc, at, lo, hi in zip(got["doc"], got["at"], got["lo"], got["hi"], strict=True):
        for p in range(lo, hi + 1):
            content = tuple(flat[p : p + window].tolist())
            assert chosen.setdefault(content, at - p) == at - p and 0 <= at - p <= more
    starts = A.starts_of(lengths)
    expected = sum(max(0, n - window + 1) for n in lengths)
    assert sum(int(h - l + 1) for l, h in zip(got["lo"], got["hi"], strict=True)) == expected
    assert all(starts[d] <= l for d, l in zip(got["doc"], got["lo"], strict=True))


def test_merged():
    lo, hi = A.merged(np.array([5, 0, 20, 3, 8]), np.array([8, 4, 30, 5, 9]))
    assert (lo.tolist(), hi.tolist()) == ([0, 20], [9, 30])


def periodic_texts(seed):
    """Texts that repeat a line of a few words, alone, cut off, behind and before others, and in several phases."""
    rnd = random.Random(seed)
    rows = []
    for i in range(60):
        line = [f"p{rnd.randrange(3)}w{k}" for k in range(rnd.choice((1, 2, 2, 2, 7, 26, 30)))]
        run = (line * 200)[rnd.randrange(len(line)) :][: rnd.choice((49, 50, 51, 77, 130, 300))]
        before, after = ([f"{side}{rnd.randrange(9)}" for _ in range(rnd.choice((0, 3, 60)))] for side in "ba")
        rows.append((i, " ".join([*before, *run, *after, *(run if i % 7 == 0 else [])])))
    return rows


@pytest.mark.parametrize("window,k", [(50, 25), (50, 50), (12, 5)])
def test_texts_that_repeat_a_line_like_brute_force(texts, window, k):
    rows = periodic_texts(window + k)
    gone = brute(rows, lambda t: t.split(), window, False)
    got = {r["row"]["doc_id"]: r["cut"] for r in debruijn.remove_repeated_words(
        texts(rows), window=window, k=k).collect()}
    for doc, text in rows:
        kept = " ".join(w for i, w in enumerate(text.split()) if i not in gone.get(doc, ()))
        assert (got[doc]["n_removed"], got[doc]["kept"]) == (len(gone.get(doc, ())), kept)


def test_a_repeated_line_makes_rows_per_text_not_per_repeat(texts, monkeypatch):
    tables = {}
    keep = debruijn.written
    monkeypatch.setattr(debruijn, "written", lambda df, name: tables.setdefault(name, keep(df, name)))
    docs = W.keyed(texts([(i, "the same " * (200 + i)) for i in range(20)]), "doc_id", "text")
    ranges = debruijn.repeated_ranges(docs).groupBy("_id").agg(F.min("lo"), F.max("hi")).collect()
    assert sorted(map(tuple, ranges)) == [(i, 0, 2 * (200 + i)) for i in range(1, 20)]
    assert tables["word-edges"].count() <= 4 * 20 and tables["word-sides"].count() <= 4 * 20
