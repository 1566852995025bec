import math
from collections import Counter

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import CountVectorizerModel, StopWordsRemover, StringIndexer
from pyspark.sql import functions as F

from opinaria.functions import stop_words
from opinaria.functions.stemming import stem, stem_word, stem_words
from opinaria.functions.text import tokens
from opinaria.operators import dimension, row_ids
from opinaria.operators import naive_bayes as nb
from opinaria.operators import tokens as tk
from opinaria.plans import registry, training

# Sample pairs of the published vocabulary.
GOLDEN = (
    "boa boa boainain boainain boas boas bôas bôas boassu boassu boataria boat boate boat boates boat "
    "boatos boat bob bob boba bob bobagem bobag bobagens bobagens bobalhões bobalhõ bobear bob "
    "bobeira bobeir bobinho bobinh bobinhos bobinh bobo bob bobs bobs boca boc bocadas boc "
    "bocadinho bocadinh bocado boc bocaiúva bocaiúv boçal boçal bocarra bocarr bocas boc bode bod "
    "bodoque bodoqu body body boeing boeing boem boem boemia boem boêmio boêmi bogotá bogot boi boi "
    "bóia bói boiando boi quiabo quiab quicaram quic quickly quickly quieto quiet quietos quiet "
    "quilate quilat quilates quilat quilinhos quilinh quilo quil quilombo quilomb quilométricas "
    "quilométr quilométricos quilométr quilômetro quilômetr quilômetros quilômetr quilos quil quimera quim"
).split()
PAIRS = list(zip(GOLDEN[::2], GOLDEN[1::2]))

REVIEWS = [
    (1, "pos", "filme bom bom ótimo"), (2, "pos", "ótimo ótimo elenco"), (3, "neg", "filme ruim ruim"),
    (4, "neg", "péssimo elenco ruim"), (5, "pos", "bom"), (6, "neg", "ruim filme bom"), (7, "neg", ""),
]


@pytest.fixture
def words(spark):
    df = spark.createDataFrame(REVIEWS, "id bigint, label string, text string")
    return training.training_words(df, stem=False)


def test_stemmer_golden_words(apply):
    assert [stem(w) for w, _ in PAIRS] == [s for _, s in PAIRS]
    assert apply(stem_word, [w for w, _ in PAIRS]) == [s for _, s in PAIRS]


def test_stemmer_suffix_rules():
    expected = {
        "felizmente": "feliz", "rapidamente": "rapid", "psicologia": "psicolog", "solução": "soluçã",
        "consequência": "consequent", "nacionalidade": "nacional", "alternativa": "altern",
        "organização": "organiz", "primeira": "primeir", "distingue": "disting", "faço": "fac",
    }
    assert {w: stem(w) for w in expected} == expected


def test_stem_arrays_keep_shape(spark):
    df = spark.createDataFrame(
        [(1, ["bobo", "bobagem", "bobo"]), (2, []), (3, None), (4, ["quilos"])], "i int, w array<string>"
    ).repartition(3)
    got = {r["i"]: r["s"] for r in df.select("i", stem_words("w").alias("s")).collect()}
    assert got == {1: ["bob", "bobag", "bob"], 2: [], 3: None, 4: ["quil"]}


def test_stop_words_are_those_spark_publishes(spark):
    names = {"de": "german", "en": "english", "es": "spanish", "fr": "french", "pt": "portuguese"}
    assert set(names) == set(stop_words.LANGUAGES)
    for code, name in names.items():
        assert stop_words.stop_words(code) == StopWordsRemover.loadDefaultStopWords(name)


def test_stop_word_join_equals_array_filter(spark):
    stop = spark.createDataFrame([("pt", "o"), ("pt", "de"), ("en", "the")], "lang string, term string")
    df = spark.createDataFrame(
        [(1, "pt", "o bom de the"), (2, "en", "the o"), (3, "fr", "the o")], "id int, lang string, text string"
    ).withColumn("words", tokens(F.col("text")))
    rows = tk.without_stop_words(tk.explode_words(df, "words", "id", "lang"), stop, ("lang", "term"))
    joined = Counter((r["id"], r["term"]) for r in rows.collect())
    filtered = df.select("id", F.explode(tk.word_array(
        F.col("text"), language=F.col("lang"), stop_words={"pt": ["o", "de"], "en": ["the"]})).alias("term"))
    assert joined == Counter((r["id"], r["term"]) for r in filtered.collect())


def test_lookup_join_large_side_equals_broadcast(spark):
    facts = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("term"))
    lookup = spark.range(40).select(F.concat(F.lit("k"), "id").alias("term"), F.col("id").alias("x")).union(
        spark.createDataFrame([("hot", 99)], "term string, x bigint"))
    for how in ("inner", "left", "left_anti"):
        small = dimension.lookup_join(facts, lookup, ["term"], how)
        large = dimension.lookup_join(facts, lookup, ["term"], how, max_rows=5, salts=7)
        assert small.columns == large.columns or set(small.columns) == set(large.columns)
        assert sorted(map(repr, small.select(*sorted(small.columns)).collect())) == sorted(
            map(repr, large.select(*sorted(large.columns)).collect()))
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan


def test_bag_and_vocabulary(words):
    bag = {(r["id"], r["term"]): r["n"] for r in tk.bag_of_words(words).collect()}
    expected = {
        (i, t): n for i, _, text in REVIEWS for t, n in Counter(text.split()).items()
    }
    assert bag == expected
    vocab = {r["term"]: r["term_idx"] for r in tk.vocabulary(words, max_features=3).collect()}
    # bom 4, ruim 4, then filme 3 ties with ótimo 3 and comes first.
    assert vocab == {"bom": 0, "filme": 1, "ruim": 2}
    assert [r["term"] for r in tk.first_terms(tk.vocabulary(words), 2).collect()] == ["bom", "elenco"]


def test_one_letter_words_are_not_counted(spark):
    df = spark.createDataFrame([(1, ["a", "é", "ab"])], "id int, words array<string>")
    assert [r["term"] for r in tk.bag_of_words(df).collect()] == ["ab"]


@pytest.mark.parametrize("kind", [nb.MULTINOMIAL, nb.BERNOULLI])
def test_scores_equal_spark_ml_after_prior_correction(words, kind):
    vocab_rows = sorted(tk.vocabulary(words).collect(), key=lambda r: r["term_idx"])
    terms = [r["term"] for r in vocab_rows]
    vectors = CountVectorizerModel.from_vocabulary(terms, "words", "features").setBinary(kind == nb.BERNOULLI)
    indexer = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(words)
    data = indexer.transform(vectors.transform(words))
    fitted = NaiveBayes(featuresCol="features", labelCol="y", modelType=kind, smoothing=1.0).fit(data)
    raw = {r["id"]: r["rawPrediction"] for r in fitted.transform(data).select("id", "rawPrediction").collect()}
    counts = Counter(label for _, label, _ in REVIEWS)
    total, labels = len(REVIEWS), sorted(counts)
    fix = [math.log(counts[c] / total) - math.log((counts[c] + 1) / (total + len(labels))) for c in labels]
    scores = nb.score_rows(nb.class_scores(words, nb.fit(words, kind=kind))).collect()
    assert len(scores) == len(REVIEWS) * 2
    for r in scores:
        at = labels.index(r["label"])
        assert r["score"] == pytest.approx(raw[r["id"]][at] + fix[at], abs=2e-6)


def test_text_without_vocabulary_word_is_scored(spark, words):
    model = nb.fit(words, kind=nb.MULTINOMIAL)
    new = spark.createDataFrame([(1, ["xyz"]), (2, [])], "id bigint, words array<string>")
    got = {r["id"]: r["prediction"] for r in nb.predict(new, model).collect()}
    # Only the priors speak: 4 of 7 reviews are negative.
    assert got == {1: "neg", 2: "neg"}


def test_tie_goes_to_the_first_label_and_unseen_class_is_never_chosen(spark):
    df = spark.createDataFrame([(1, "b", ["xx"]), (2, "a", ["xx"])], "id bigint, label string, words array<string>")
    model = nb.fit(df, kind=nb.BERNOULLI, labels=["a", "b", "z"])
    assert {r["prediction"] for r in nb.predict(df, model).collect()} == {"a"}


def test_model_round_trip(spark, words, tmp_path):
    model = nb.fit(words, kind=nb.BERNOULLI)
    nb.save_model(model, str(tmp_path / "m"))
    again = nb.load_model(spark, str(tmp_path / "m"))
    assert (again.kind, again.labels) == (model.kind, model.labels)
    assert sorted(map(tuple, nb.predict(words, again).collect())) == sorted(
        map(tuple, nb.predict(words, model).collect()))


def test_training_plan(spark):
    rows = [(i, "pos" if i % 2 else "neg", "bom filme" if i % 2 else "ruim filme") for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, label string, text string")
    done = training.train_and_evaluate(training.training_words(df))
    assert {r["model"]: r["accuracy"] for r in done.accuracies.collect()} == {"multinomial": 1.0, "bernoulli": 1.0}
    assert done.chosen().kind == nb.BERNOULLI
    fresh = spark.createDataFrame([(1, "Que filme <b>RUINS</b>"), (2, "bom!")], "id bigint, text string")
    got = training.predict_texts(fresh, done.chosen())
    assert {r["id"] for r in got.collect()} == {1, 2}
    with pytest.raises(ValueError):
        training.train_and_evaluate(df, fit_on="test")


@pytest.mark.parametrize("lists", [["que", "um"], {"pt": ["que", "um"], "en": ["the"]}])
def test_a_model_brings_its_preparation(spark, tmp_path, lists):
    rows = [(i, "pt", "pos" if i % 2 else "neg", "que bom filme" if i % 2 else "que ruim filme") for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, lang string, label string, text string")
    prepared = nb.Preparation(lists, stem=True)
    done = training.train_texts(df, prepared, language=F.col("lang"))
    assert "que" not in {r["term"] for r in done.chosen().vocab.collect()}
    nb.save_model(done.chosen(), str(tmp_path / "m"))
    again = nb.load_model(spark, str(tmp_path / "m"))
    assert again.preparation == prepared
    fresh = spark.createDataFrame([(1, "pt", "QUE RUINS"), (2, "pt", "bom!")], "id bigint, lang string, text string")
    got = training.predict_texts(fresh, again, language=F.col("lang"))
    assert {r["id"]: r["prediction"] for r in got.collect()} == {1: "neg", 2: "pos"}
    with pytest.raises(ValueError):
        training.predict_texts(fresh, again, language=F.col("lang"), stem=False)


def test_stop_words_by_language_need_a_language(spark):
    with pytest.raises(ValueError):
        nb.Preparation({"pt": ["que"]}).words(F.col("text"))


@pytest.mark.parametrize("per_document", [True, False])
def test_terms_of_a_large_vocabulary_are_counted_before_the_join(spark, words, per_document):
    vocab = tk.vocabulary(words)
    small, large = (
        nb.class_term_counts(words, vocab, ["neg", "pos"], per_document=per_document, max_features=n)
        for n in (1000, dimension.MAX_BROADCAST_ROWS + 1))
    assert small.dtypes == large.dtypes
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_row_ids_are_dense_and_ordered(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.when(F.col("id") < 2000, "hot").otherwise(
        (F.col("id") % 5).cast("string")).alias("g")).repartition(6)
    got = row_ids.with_row_ids(df, "k", name="n").collect()
    assert sorted((r["k"], r["n"]) for r in got) == [(i, i + 1) for i in range(5000)]
    within = row_ids.with_row_ids_within(df, "g", "k", name="n").collect()
    groups = {}
    for r in within:
        groups.setdefault(r["g"], []).append((r["k"], r["n"]))
    for rows in groups.values():
        assert [n for _, n in sorted(rows)] == list(range(1, len(rows) + 1))
    assert row_ids.with_row_ids(df.filter("k < 0"), "k").count() == 0
