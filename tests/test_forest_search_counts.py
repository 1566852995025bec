"""Comment forests, ranked search and additive counts against plain Python."""

import math
import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from opinaria.operators import counts as ct
from opinaria.operators import naive_bayes as nb
from opinaria.operators import search
from opinaria.operators.tokens import vocabulary
from opinaria.sources import forest, posts

REPLIES = "post_id long, comment_id long, parent_id long, pos long, body string"


def walk(rows):
    """{post: comment ids in breadth-first order} by a queue per post."""
    below, known = defaultdict(list), {(p, c) for p, c, *_ in rows}
    for post, comment, parent, pos, _ in rows:
        below[post, parent if (post, parent) in known else None].append((pos, comment))
    out = {}
    for post in {r[0] for r in rows}:
        queue, seen = deque(sorted(below[post, None])), []
        while queue:
            _, comment = queue.popleft()
            seen.append(comment)
            queue.extend(sorted(below[post, comment]))
        out[post] = seen
    return out


def flattened(spark, rows, limit=None):
    made = spark.createDataFrame(rows, REPLIES).repartition(3)
    got = defaultdict(list)
    for r in sorted(forest.first_in_breadth(forest.with_depth(made), limit).collect(), key=lambda r: (r["post_id"], r["place"])):
        got[r["post_id"]].append(r["comment_id"])
    return dict(got)


def test_forest_equals_a_walk(spark):
    rnd = random.Random(4)
    rows = []
    for post in range(6):
        for comment in range(1, 40):
            parent = rnd.choice([None, *range(1, comment)]) if post else comment - 1 or None
            rows.append((post, comment, parent, rnd.randrange(4), f"c{comment}"))
    rows += [(7, 1, 99, 0, "its parent is gone"), (7, 2, 1, 0, "answer"), (7, 5, None, -1, "first")]
    expected = walk(rows)
    assert flattened(spark, rows) == expected
    assert flattened(spark, rows, 5) == {p: seen[:5] for p, seen in expected.items()}
    # Post 0 is one chain: every comment is one deeper than what it answers.
    deep = {r["comment_id"]: r["depth"] for r in forest.with_depth(spark.createDataFrame(rows, REPLIES)).filter("post_id = 0").collect()}
    assert deep == {c: c for c in range(1, 40)}


def test_cycles_have_no_place_and_repeated_ids_are_an_error(spark):
    rows = [(1, 1, None, 0, "a"), (1, 2, 3, 0, "b"), (1, 3, 4, 0, "c"), (1, 4, 2, 0, "d"), (1, 5, 4, 0, "e"), (1, 6, 6, 0, "f"),
            (1, 7, 1, 0, "g"), (2, 2, 3, 0, "h"), (2, 3, None, 0, "i")]
    placed = forest.with_depth(spark.createDataFrame(rows, REPLIES)).collect()
    assert {(r["post_id"], r["comment_id"]): r["depth"] for r in placed} == {
        (1, 1): 1, (1, 7): 2, (2, 3): 1, (2, 2): 2, **{(1, c): None for c in (2, 3, 4, 5, 6)}}
    assert flattened(spark, rows) == {1: [1, 7], 2: [3, 2]}
    with pytest.raises(ValueError):
        forest.paths(spark.createDataFrame([rows[0], rows[0]], REPLIES))
    assert forest.with_depth(spark.createDataFrame([], REPLIES)).count() == 0


def test_texts_of_a_forest(spark):
    titles = spark.createDataFrame([(1, "Title"), (2, ""), (3, None)], "post_id long, title string")
    rows = [(1, 1, None, 2, "second"), (1, 2, None, 1, "first"), (1, 3, 2, 0, "answer"), (1, 4, 3, 0, " "), (2, 1, None, 0, "<b>bold</b>")]
    got = forest.texts_of_forest(titles, spark.createDataFrame(rows, REPLIES), 4).collect()
    assert sorted((r["post_id"], r["pos"], r["origem"], r["texto"]) for r in got) == [
        (1, 0, posts.TITLE, "Title"), (1, 1, posts.COMMENT, "first"), (1, 2, posts.COMMENT, "second"),
        (1, 3, posts.COMMENT, "answer"), (2, 1, posts.COMMENT, "bold")]


def bm25(texts, keyword):
    words = {i: t.lower().split() for i, t in texts if t}
    words = {i: w for i, w in words.items() if w}
    mean = sum(map(len, words.values())) / len(words)
    scores = {}
    for i, w in words.items():
        counts, score = Counter(w), 0.0
        for term in set(keyword.lower().split()):
            n = sum(term in other for other in words.values())
            f = counts[term]
            score += math.log1p((len(words) - n + 0.5) / (n + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean))
        if set(keyword.lower().split()) & set(w):
            scores[i] = round(score, 6)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))


def test_search_equals_plain_bm25(spark, tmp_path):
    rnd = random.Random(8)
    texts = [(i, " ".join(rnd.choice(("Film", "bom", "ruim", "caro", "o", "a", f"w{i % 5}")) for _ in range(rnd.randrange(1, 30))))
             for i in range(60)]
    texts += [(100, ""), (101, None), (102, "bom bom"), (103, "bom bom")]
    path = str(tmp_path / "index")
    search.write_index(spark.createDataFrame(texts, "post_id long, title string").repartition(4), path)
    keywords = ["bom", " Film w1 film ", "nothing such", "caro O a"]
    got = defaultdict(list)
    for r in sorted(search.search(spark, path, keywords, 7).collect(), key=lambda r: (r["keyword"], r["rank"])):
        got[r["keyword"]].append((r["post_id"], r["score"]))
    for keyword in keywords:
        expected = bm25(texts, keyword)[:7]
        assert [p for p, _ in got[keyword]] == [p for p, _ in expected]
        assert [s for _, s in got[keyword]] == pytest.approx([s for _, s in expected], abs=2e-6)
    for bad in (["  "], ["..."], ["bom", "!"]):
        with pytest.raises(ValueError):
            search.search(spark, path, bad, 7)


def test_search_in_an_empty_index(spark, tmp_path):
    path = str(tmp_path / "index")
    search.write_index(spark.createDataFrame([(1, None)], "post_id long, title string"), path)
    assert search.search(spark, path, ["bom"], 5).collect() == []


def labelled_words(spark, n, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(("neg", "pos", None) if i % 9 == 0 else ("neg", "pos")),
             [rnd.choice(("aa", "bb", "cc", "dd", f"e{i % 7}", "x")) for _ in range(rnd.randrange(12))]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, label string, words array<string>").repartition(3)


def weights(model):
    return {(r["label"], r["term"]): round(r["weight"], 9) for r in model.term_weights.collect()}


@pytest.mark.parametrize("kind", [nb.MULTINOMIAL, nb.BERNOULLI])
def test_parts_train_as_the_whole(spark, tmp_path, kind):
    _, words = labelled_words(spark, 90, 1)
    for i, name in enumerate(("a", "b", "c")):
        ct.save_counts(ct.count_texts(words.filter(F.col("id") % 3 == i)), str(tmp_path / "counts"), name)
    merged = ct.load_counts(spark, str(tmp_path / "counts"), ["c", "a", "b"])
    known = words.filter("label IS NOT NULL")
    at_once = nb.fit(known, kind=kind, vocab=vocabulary(known, "words", 6), max_features=6)
    assert weights(ct.model_of(merged, kind, max_features=6)) == weights(at_once)
    two = ct.load_counts(spark, str(tmp_path / "counts"), ["a", "b"])
    assert weights(ct.model_of(two, kind, max_features=6)) != weights(at_once)


def test_gaussian_equals_the_formula(spark):
    rows, words = labelled_words(spark, 80, 2)
    model = ct.gaussian_model(ct.count_texts(words), max_features=5)
    known = [(label, Counter(w for w in ws if len(w) > 1)) for _, label, ws in rows if label]
    totals = Counter()
    for _, c in known:
        totals.update(c)
    vocab = sorted(totals, key=lambda t: (-totals[t], t))[:5]

    def moments(texts, term):
        values = [c[term] for c in texts]
        mean = sum(values) / len(values)
        return mean, sum(v * v for v in values) / len(values) - mean * mean

    floor = 1e-9 * max(moments([c for _, c in known], t)[1] for t in vocab)
    by_class = {name: [c for label, c in known if label == name] for name in ("neg", "pos")}
    got = {r["id"]: {s["label"]: s["score"] for s in r["scores"]} for r in ct.gaussian_scores(words, model).collect()}
    assert set(got) == {i for i, *_ in rows}
    for i, _, ws in rows:
        c = Counter(ws)
        for name, texts in by_class.items():
            score = math.log(len(texts) / len(known))
            for t in vocab:
                m, v = moments(texts, t)
                score -= 0.5 * math.log(2 * math.pi * (v + floor)) + (c[t] - m) ** 2 / (2 * (v + floor))
            assert got[i][name] == pytest.approx(score, rel=1e-6, abs=1e-6)


def test_gaussian_without_any_variance(spark):
    rows = [(i, ("neg", "pos")[i % 2], ["aa", "bb"]) for i in range(6)]
    model = ct.gaussian_model(ct.count_texts(spark.createDataFrame(rows, "id long, label string, words array<string>")))
    texts = spark.createDataFrame([(1, ["aa", "bb"]), (2, []), (3, None)], "id long, words array<string>")
    assert {r["id"]: r["prediction"] for r in ct.predict_gaussian(texts, model).collect()} == {1: "neg", 2: "neg", 3: "neg"}
