"""The context rules against a plain row-by-row statement of them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from opinaria.operators import lexicon as lx

VALENCES = {
    "good": 1.9, "great": 3.1, "bad": -2.5, "no": -1.2, "awful": -2.0, "fun": 2.3, "kind": 2.4, "die": -2.9,
    "heart": 3.2, "sad": -2.1, "yes": 1.7, "shit": -2.6,
}


def words_of(text):
    out = []
    for piece in text.split():
        core = piece.strip(lx.PUNCTUATION)
        out.append(piece if len(core) <= 2 else core)
    return out


def boost_of(word, v, mixed):
    low = word.lower()
    if low not in lx.BOOSTERS and low not in lx.DAMPENERS:
        return 0.0
    size = lx.BOOST if low in lx.BOOSTERS else lx.DAMPEN
    size = -size if v < 0 else size
    if word.isupper() and mixed:
        size += lx.CAPITALS if v > 0 else -lx.CAPITALS
    return size


def negates(word):
    return word in lx.NEGATIONS or "n't" in word


def expected(text):
    text = text.strip()
    raw = words_of(text)
    low = [w.lower() for w in raw]
    caps = sum(w.isupper() for w in raw)
    mixed = 0 < len(raw) - caps < len(raw)
    total = 0.0
    cut = low.index("but") if "but" in low else None
    for i, w in enumerate(low):
        v = 0.0
        skip = w in lx.BOOSTERS or w in lx.DAMPENERS or (w == "kind" and low[i + 1:i + 2] == ["of"])
        if w in VALENCES and not skip:
            v = VALENCES[w]
            if w == "no" and i + 1 < len(low) and low[i + 1] in VALENCES:
                v = 0.0
            back = lambda k: low[i - k] if i >= k else None
            if back(1) == "no" or back(2) == "no" or (back(3) == "no" and back(1) in ("or", "nor")):
                v = VALENCES[w] * lx.NEGATION
            if raw[i].isupper() and mixed:
                v += lx.CAPITALS if v > 0 else -lx.CAPITALS
            for k, fade in ((1, 1.0), (2, 0.95), (3, 0.9)):
                if back(k) is None or back(k) in VALENCES:
                    continue
                v += fade * boost_of(raw[i - k], v, mixed)
                one, two, three = back(1), back(2), back(3)
                if k == 1:
                    v = v * lx.NEGATION if negates(one) else v
                elif k == 2:
                    if two == "never" and one in ("so", "this"):
                        v *= 1.25
                    elif not (two == "without" and one == "doubt") and negates(two):
                        v *= lx.NEGATION
                else:
                    if (three == "never" and two in ("so", "this")) or one in ("so", "this"):
                        v *= 1.25
                    elif not (three == "without" and "doubt" in (two, one)) and negates(three):
                        v *= lx.NEGATION
                    for phrase in ((one, w), (two, one, w), (two, one), (three, two, one), (three, two)):
                        if " ".join(phrase) in lx.IDIOMS:
                            v = lx.IDIOMS[" ".join(phrase)]
                            break
                    for n in (2, 3):
                        ahead = " ".join(low[i:i + n])
                        if i + n <= len(low) and ahead in lx.IDIOMS:
                            v = lx.IDIOMS[ahead]
                    for pair in (f"{three} {two}", f"{two} {one}"):
                        v += lx.DAMPEN if pair in lx.DAMPENER_PAIRS else 0.0
            if back(1) == "least" and back(1) not in VALENCES and back(2) not in ("at", "very"):
                v *= lx.NEGATION
            if cut is not None:
                v *= 0.5 if i < cut else 1.5 if i > cut else 1.0
        total += v
    marks = min(text.count("!"), 4) * lx.EXCLAMATION
    asked = text.count("?")
    marks += 0.96 if asked > 3 else asked * 0.18 if asked > 1 else 0.0
    total += marks if total > 0 else -marks if total < 0 else 0.0
    return round(total / math.sqrt(total * total + 15), 4)


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(list(VALENCES.items()), "term string, valence double")


def scored(spark, lexicon, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, texto string")
    got = {r["id"]: r["compound"] for r in lx.context_scores(df, lexicon, **options).collect()}
    return [got[i] for i in range(len(texts))]


SENTENCES = [
    "good", "GOOD day", "GOOD", "not good", "very good", "VERY good", "isn't very good", "never so good",
    "without a doubt good", "without doubt good", "it is kind of good today", "kind of bad", "no good",
    "no", "no or yes nor fun", "good but bad", "bad, but GREAT!!!", "good!!!!!!", "bad??", "bad????", "at least good",
    "least good", "the very least good", "so this is to die for", "they had a broken heart today", "beating heart",
    "well yeah right good now", "that is the shit man really", ":) !", "", "   ", "(good)", "...great...", "x",
    "hardly any of it fun", "this is just enough fun", "so so sad", "never this great",
]


def test_rules_on_sentences(spark, lexicon):
    assert scored(spark, lexicon, SENTENCES) == pytest.approx([expected(s) for s in SENTENCES], abs=1e-4)


def test_rules_on_random_texts(spark, lexicon):
    pool = [
        *VALENCES, "not", "never", "so", "this", "without", "doubt", "very", "barely", "kind", "of", "sort", "just",
        "enough", "least", "at", "but", "or", "nor", "the", "to", "for", "broken", "isn't", "film", "Very", "NOT",
        "GOOD", "BAD", "good!", "(bad)", "fun?", "THE",
    ]
    rng = random.Random(5)
    texts = [" ".join(rng.choices(pool, k=rng.randint(1, 14))) for _ in range(600)]
    assert scored(spark, lexicon, texts) == pytest.approx([expected(t) for t in texts], abs=1.01e-4)


def test_plain_scores(spark, lexicon):
    df = spark.createDataFrame([(1, "Good, good bad"), (2, "nada"), (3, ""), (4, None)], "id bigint, texto string")
    got = {r["id"]: r["compound"] for r in lx.plain_scores(df, lexicon).collect()}
    total = 1.9 + 1.9 - 2.5
    assert got == {1: round(total / math.sqrt(total**2 + 15), 4), 2: 0.0, 3: 0.0, 4: 0.0}


def test_emoji_are_read_as_words(spark, lexicon):
    names = {"😀": "good face", "😢": "sad face"}
    df = spark.createDataFrame([("😀x",), ("a😀",), ("a 😢😀",), ("😀😀",), ("é 🤷",), (None,)], "t string")
    got = [r[0] for r in df.select(lx.emoji_as_words(F.col("t"), names)).collect()]
    assert got == ["good facex", "a good face", "a sad face good face", "good face good face", "é 🤷", None]
    assert scored(spark, lexicon, ["😀"], emoji_descriptions=names) == [expected("good face")]


def test_label_column_keeps_every_row(spark, lexicon):
    df = spark.createDataFrame([(1, "great"), (2, "bad"), (3, "mesa")], "id bigint, texto string")
    got = {r["id"]: r["sent_vader"] for r in lx.with_lexicon_label(df, lexicon).collect()}
    assert got == {1: "positivo", 2: "negativo", 3: "neutro"}


def test_texts_without_sentiment_words_and_nulls_keep_a_row(spark, lexicon):
    rows = [(1, None), (2, ""), (3, "mesa !!!"), (4, "very"), (5, "no"), (6, "no very"), (7, "good")]
    df = spark.createDataFrame(rows, "id bigint, texto string")
    got = {r["id"]: r["compound"] for r in lx.context_scores(df, lexicon).collect()}
    assert got == {i: expected(t or "") for i, t in rows}
    assert lx.context_scores(df.limit(0), lexicon).count() == 0
    assert lx.plain_scores(df.limit(0), lexicon).count() == 0


def test_a_large_lexicon_is_joined_by_shuffle_with_the_same_scores(spark, lexicon, monkeypatch):
    df = spark.createDataFrame(list(enumerate([*SENTENCES, None])), "id bigint, texto string")
    context, plain = (sorted(map(tuple, f(df, lexicon).collect())) for f in (lx.context_scores, lx.plain_scores))
    monkeypatch.setattr(lx, "_lexicon_size", lambda _: 10**9)
    large = lx.context_scores(df, lexicon)
    assert sorted(map(tuple, large.collect())) == context
    assert sorted(map(tuple, lx.plain_scores(df, lexicon).collect())) == plain


def test_a_lexicon_with_other_columns_and_an_empty_term(spark, lexicon):
    wide = lexicon.selectExpr("term", "valence", "1 AS word", "2 AS id").unionAll(
        spark.createDataFrame([("", 9.0, 1, 2)], "term string, valence double, word int, id int"))
    df = spark.createDataFrame(list(enumerate(SENTENCES)), "id bigint, texto string")
    for scores in (lx.context_scores, lx.plain_scores):
        assert sorted(map(tuple, scores(df, wide).collect())) == sorted(map(tuple, scores(df, lexicon).collect()))


def test_only_sentiment_words_reach_the_rules(spark, lexicon):
    df = spark.createDataFrame([(1, "one good word among many others")], "id bigint, texto string")
    plan = lx.context_scores(df, lexicon)._jdf.queryExecution().optimizedPlan().toString()
    first = [line for line in plan.splitlines() if "Join" in line][-1]
    assert "Join Inner" in first


def test_words_without_sentiment_take_no_neighbours_along(spark):
    """Neighbours are read behind the join with the lexicon, and no text is split twice for a size filter."""
    texts = spark.createDataFrame([(1, "a very good day"), (2, None)], "id long, texto string")
    words = spark.createDataFrame([("good", 1.9)], "term string, valence double")
    scores = lx.context_scores(texts, words)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    generated = next(line for line in plan.splitlines() if "Generate" in line)
    assert "arrays_zip" not in plan and "w1#" not in generated and "Filter ((size(" not in plan
    assert {r["id"]: r["compound"] > 0 for r in scores.collect()} == {1: True, 2: False}
