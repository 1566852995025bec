"""One query per operator over the driver's tables; each reads whole tables.

``documents`` stand for reviews, ``labels.quality`` for their sentiment, ``pages.html`` for tagged
text, and ``conversations`` for posts (turn 0 is the title, later turns are the comments).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from opinaria.functions import labels as L
from opinaria.functions import text as X
from opinaria.functions.stop_words import stop_words
from opinaria.operators import evaluate as ev
from opinaria.operators import counts as ct
from opinaria.operators import answer_store, external, heavy_terms, lexicon, profile, search, summary
from opinaria.operators import naive_bayes as nb
from opinaria.operators import tokens as tk
from opinaria.operators.row_ids import with_row_ids, with_row_ids_within
from opinaria.plans import answers, classification, training
from opinaria.sources import files, forest, posts
from opinaria.sources.scratch import materialise, new_path
from opinaria.sources.tables import read_table, spread
from opinaria.streaming import drop_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LANGUAGES = ("de", "en", "es", "fr")
REVIEW_CLASSES = ("neg", "pos")
KEYWORD = "the"
KEYWORDS = ("the", "of and ing", "Que la", "der und")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---- inputs -------------------------------------------------------------------------------------


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spread(read_table(spark, f"{sf}/documents.parquet", "doc_id", *columns), "doc_id")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_table(spark, f"{sf}/pages.parquet", "page_id", "html"), "page_id")


def raw_labels(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, f"{sf}/labels.parquet", "doc_id", "quality", "toxic")


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text, lang, label): the documents which have a label."""
    label = F.when(F.col("quality") == 1, "pos").otherwise("neg")
    marked = raw_labels(spark, sf).select("doc_id", label.alias("label"))
    return documents(spark, sf, "text", "lang").join(marked, "doc_id").withColumnRenamed("doc_id", "id")


def post_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Posts (post_id, title) and comments (post_id, pos, body)."""
    turns = read_table(spark, f"{sf}/conversations.parquet", "conv_id", "turn", "text")
    titles = turns.filter("turn = 0").select(
        F.col("conv_id").alias("post_id"), F.col("text").alias("title")
    )
    comments = turns.filter("turn > 0").select(
        F.col("conv_id").alias("post_id"), F.col("turn").alias("pos"), F.col("text").alias("body")
    )
    return titles, comments


def turn_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(id, origem, texto): every turn as a cleaned text with an id of its own."""
    turns = read_table(spark, f"{sf}/conversations.parquet", "conv_id", "turn", "text")
    return summary.cleaned_rows(
        turns, F.col("text"),
        F.concat_ws(":", "conv_id", "turn").alias("id"),
        F.when(F.col("turn") == 0, posts.TITLE).otherwise(posts.COMMENT).alias("origem"),
    )


def responses_for(rows: DataFrame) -> DataFrame:
    """(id, answer, error): an answer for most ids, a failure for some, nothing for the rest.

    The answer follows from a digest of the id, and every kind of answer occurs.
    """
    digit = F.substring(F.md5(F.col("id").cast("string")), 1, 1)
    answer = (
        F.when(digit.isin("0", "1", "2", "3"), "positivo")
        .when(digit.isin("4", "5"), " Positivo.")
        .when(digit.isin("6", "7", "8"), "negativo")
        .when(digit == "9", "NEGATIVO\n")
        .when(digit == "a", "neutra")
        .when(digit == "b", "Neither")
        .when(digit == "c", "")
    )
    made = rows.select("id", answer.alias("answer"), (digit == "e").alias("error"), digit.alias("digit"))
    return made.filter("digit <> 'f'").drop("digit")


def stop_lists() -> dict[str, list[str]]:
    return {code: stop_words(code) for code in LANGUAGES}


def stop_table(spark: SparkSession) -> DataFrame:
    pairs = [(code, word) for code, listed in stop_lists().items() for word in listed]
    return spark.createDataFrame(pairs, "lang string, term string")


def document_words(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf, "text").select("doc_id", X.tokens(F.col("text")).alias("words"))


def review_words(spark: SparkSession, sf: str) -> DataFrame:
    """(id, label, words) without stop-word removal and stemming."""
    return training.training_words(reviews(spark, sf), stem=False)


def full_words(spark: SparkSession, sf: str) -> DataFrame:
    """(id, label, words) with stop words of the text's language removed, and stemmed."""
    return training.training_words(
        reviews(spark, sf), language=F.col("lang"), stop_words=stop_lists(), stem=True
    )


def word_valences(spark: SparkSession, sf: str) -> DataFrame:
    """(term, valence): a lexicon learned from the labelled reviews, on the usual -4 to 4 scale.

    The valence is how much more a term belongs to the good class than to the other one.
    """
    counts = tk.term_rows(review_words(spark, sf), "label").groupBy("term").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("label") == name).alias(name) for name in REVIEW_CLASSES],
    )
    # The windows see the top terms only.
    everything = Window.partitionBy()

    def share(name: str) -> Column:
        total = F.sum(name).over(everything) + F.count("*").over(everything)
        return F.log((F.col(name) + 1.0) / total)

    gap = F.round(share("pos") - share("neg"), 1)
    learned = tk.top_terms(counts).select(
        "term", F.greatest(F.lit(-4.0), F.least(F.lit(4.0), gap)).alias("valence")
    )
    return materialise(learned, "lexicon")


def make_keyword_scorer() -> external.Scorer:
    """A stand-in for a client: fails on texts with a question mark, else answers by keyword."""

    def scorer(text: str) -> str:
        if "?" in text:
            raise RuntimeError("refused")
        if KEYWORD in text:
            return "Positivo."
        return "negativo" if " and " in text else "neutra"

    return scorer


def split_train(words: DataFrame) -> DataFrame:
    return ev.split(words)[0]


# ---- text ---------------------------------------------------------------------------------------


@query
def clean_tags_delete(spark, sf):
    return pages(spark, sf).select("page_id", X.strip_tags(F.col("html")).alias("text"))


@query
def clean_tags_space(spark, sf):
    return pages(spark, sf).select("page_id", X.strip_tags(F.col("html"), " ").alias("text"))


@query
def strip_urls(spark, sf):
    return pages(spark, sf).select("page_id", X.strip_urls(F.col("html")).alias("text"))


@query
def collapse_whitespace(spark, sf):
    return documents(spark, sf, "text").select(
        "doc_id", X.collapse_whitespace(F.col("text")).alias("text")
    )


@query
def clean_text(spark, sf):
    return pages(spark, sf).select("page_id", X.clean_text(F.col("html")).alias("texto"))


@query
def clean_text_documents(spark, sf):
    return documents(spark, sf, "text").select("doc_id", X.clean_text(F.col("text")).alias("texto"))


@query
def special_to_space(spark, sf):
    return documents(spark, sf, "text").select(
        "doc_id", X.spaces_for_specials(F.col("text")).alias("text")
    )


@query
def normalise_alnum_lower(spark, sf):
    return documents(spark, sf, "text").select("doc_id", X.normalise(F.col("text")).alias("text"))


@query
def drop_empty(spark, sf):
    return summary.cleaned_rows(pages(spark, sf), F.col("html"), "page_id")


@query
def preview_180(spark, sf):
    cleaned = documents(spark, sf, "text").select("doc_id", X.clean_text(F.col("text")).alias("texto"))
    return cleaned.select("doc_id", X.preview(F.col("texto")).alias("texto"))


# ---- tokens -------------------------------------------------------------------------------------


@query
def token_rejoin(spark, sf):
    return document_words(spark, sf).select("doc_id", X.rejoin(F.col("words")).alias("text"))


@query
def stop_words_rejoined(spark, sf):
    words = tk.word_array(F.col("text"), language=F.col("lang"), stop_words=stop_lists())
    return documents(spark, sf, "text", "lang").select("doc_id", X.rejoin(words).alias("text"))


@query
def tokens_no_stopwords(spark, sf):
    rows = documents(spark, sf, "text", "lang").select("doc_id", "lang", X.tokens(F.col("text")).alias("words"))
    words = tk.explode_words(rows, "words", "doc_id", "lang")
    kept = tk.without_stop_words(words, stop_table(spark), ("lang", "term"))
    return kept.groupBy("lang", "term").agg(
        F.count("*").alias("n"), F.sum(F.col("pos").cast("bigint")).alias("sum_pos")
    )


@query
def term_frequencies(spark, sf):
    return tk.term_frequencies(document_words(spark, sf))


@query
def stem_vocabulary(spark, sf):
    return tk.stem_vocabulary(tk.term_frequencies(document_words(spark, sf)))


@query
def stem_frequencies(spark, sf):
    return tk.stem_frequencies(tk.term_frequencies(document_words(spark, sf)))


@query
def normalised_reviews(spark, sf):
    words = full_words(spark, sf)
    return words.select("id", "label", X.rejoin(F.col("words")).alias("text"))


@query
def bag_of_words(spark, sf):
    return tk.bag_of_words(document_words(spark, sf), "doc_id")


@query
def document_terms(spark, sf):
    words = document_words(spark, sf)
    return tk.document_terms(words, tk.vocabulary(words), "doc_id", max_features=tk.MAX_FEATURES)


@query
def vocabulary_top1000(spark, sf):
    return tk.vocabulary(document_words(spark, sf))


@query
def vocabulary_heavy(spark, sf):
    """The vocabulary's terms with their counts, from bounded summaries and an exact recount."""
    return heavy_terms.heavy_terms(materialise(document_words(spark, sf), "words"))


@query
def vocabulary_first50(spark, sf):
    return tk.first_terms(tk.vocabulary(document_words(spark, sf)))


# ---- labels -------------------------------------------------------------------------------------


@query
def label_map(spark, sf):
    raw = F.when(F.col("toxic") == 1, "other").when(F.col("quality") == 1, "pos").otherwise("neg")
    return raw_labels(spark, sf).select("doc_id", L.map_review_label(raw).alias("sentiment"))


@query
def label_normalise(spark, sf):
    ids = documents(spark, sf).select(F.col("doc_id").alias("id"))
    return responses_for(ids).select("id", L.normalise_label(F.col("answer")).alias("label"))


@query
def label_strict(spark, sf):
    ids = documents(spark, sf).select(F.col("doc_id").alias("id"))
    return responses_for(ids).select(
        "id", L.strict_label(F.col("answer"), F.col("error")).alias("label")
    )


@query
def filter_by_label(spark, sf):
    return summary.filter_by_label(response_labels(spark, sf), files.MODEL_LABEL, L.NEUTRAL)


@query
def filter_all_labels(spark, sf):
    return summary.filter_by_label(response_labels(spark, sf), files.MODEL_LABEL, L.ALL_LABELS)


# ---- posts --------------------------------------------------------------------------------------


@query
def posts_to_texts(spark, sf):
    return posts.collect_texts(*post_tables(spark, sf), KEYWORD)


@query
def all_posts_to_texts(spark, sf):
    return posts.texts_of_posts(*post_tables(spark, sf))


@query
def top5_comments(spark, sf):
    return posts.first_comments(post_tables(spark, sf)[1])


@query
def find_posts(spark, sf):
    return posts.find_posts(post_tables(spark, sf)[0], KEYWORD)


def reply_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Posts, and comments that answer others: a turn answers one of the three before it, the newest first."""
    titles, comments = post_tables(spark, sf)
    parent = F.col("pos") - 1 - F.pmod("pos", F.lit(3))
    replies = comments.select(
        "post_id", F.col("pos").alias("comment_id"), F.when(parent > 0, parent).alias("parent_id"),
        (-F.col("pos")).alias("pos"), "body")
    return titles, replies


@query
def comment_forest(spark, sf):
    """Every comment with its depth and its place in breadth-first order."""
    placed = forest.first_in_breadth(forest.with_depth(reply_tables(spark, sf)[1]), None)
    return placed.select("post_id", "comment_id", F.col("depth").cast("long").alias("depth"), F.col("place").cast("long").alias("place"))


@query
def forest_to_texts(spark, sf):
    return forest.texts_of_forest(*reply_tables(spark, sf))


def title_index(spark: SparkSession, sf: str) -> str:
    path = new_path(spark, "title-index")
    search.write_index(post_tables(spark, sf)[0], path)
    return path


@query
def ranked_search(spark, sf):
    """Several keywords in one job, over an index of all titles."""
    found = search.search(spark, title_index(spark, sf), KEYWORDS, posts.POST_LIMIT)
    return found.select("keyword", F.col("rank").cast("long").alias("rank"), "post_id", "score")


@query
def ranked_posts_to_texts(spark, sf):
    """Titles and first comments of the posts that a ranked search finds."""
    titles, comments = post_tables(spark, sf)
    return posts.collect_ranked_texts(titles, comments, title_index(spark, sf), KEYWORDS)


@query
def row_ids(spark, sf):
    texts = posts.texts_of_posts(*post_tables(spark, sf)).drop("texto")
    return with_row_ids(texts, "post_id", "pos")


@query
def row_ids_within_post(spark, sf):
    texts = posts.texts_of_posts(*post_tables(spark, sf)).drop("texto")
    return with_row_ids_within(texts, "post_id", "pos")


# ---- splitting and sampling ---------------------------------------------------------------------


@query
def split_hash(spark, sf):
    return documents(spark, sf).select("doc_id", ev.is_test_row(F.col("doc_id")).alias("is_test"))


@query
def sample_n(spark, sf):
    rows = read_table(spark, f"{sf}/documents.parquet", "doc_id", "text")
    return ev.sample_rows(rows, key="doc_id")


# ---- Naive Bayes --------------------------------------------------------------------------------


def fitted(spark: SparkSession, sf: str, kind: str) -> tuple[DataFrame, nb.NaiveBayesModel]:
    """Word arrays of the labelled reviews, and a model of their training part.

    The vocabulary is that of all labelled reviews, fitted before the split.
    """
    words = materialise(review_words(spark, sf), "words")
    vocab = materialise(tk.vocabulary(words), "vocab")
    return words, nb.fit(split_train(words), kind=kind, vocab=vocab, labels=REVIEW_CLASSES)


def rounded_weights(model: nb.NaiveBayesModel) -> DataFrame:
    return model.term_weights.select("label", "term", F.round("weight", 6).alias("weight"))


@query
def nb_priors(spark, sf):
    labelled = raw_labels(spark, sf).select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "pos").otherwise("neg").alias("label")
    )
    priors = nb.class_priors(split_train(labelled), REVIEW_CLASSES)
    return priors.select("label", "n", F.round("log_prior", 6).alias("log_prior"))


@query
def nb_multinomial_weights(spark, sf):
    return rounded_weights(fitted(spark, sf, nb.MULTINOMIAL)[1])


@query
def nb_bernoulli_weights(spark, sf):
    return rounded_weights(fitted(spark, sf, nb.BERNOULLI)[1])


@query
def nb_multinomial_scores(spark, sf):
    words, model = fitted(spark, sf, nb.MULTINOMIAL)
    return nb.score_rows(nb.class_scores(words, nb.materialised(model)))


@query
def nb_bernoulli_scores(spark, sf):
    words, model = fitted(spark, sf, nb.BERNOULLI)
    return nb.score_rows(nb.class_scores(words, nb.materialised(model)))


@query
def nb_predict(spark, sf):
    """The saved kind of model applied to every document, labelled or not."""
    model = nb.materialised(fitted(spark, sf, nb.BERNOULLI)[1])
    return training.predict_texts(documents(spark, sf, "text"), model, key="doc_id", stem=False)


@query
def nb_full_predict(spark, sf):
    """Stop words, stems, training; the model saved and loaded; every document scored the same way."""
    prepared = nb.Preparation(stop_lists(), stem=True)
    done = training.train_texts(
        reviews(spark, sf), prepared, language=F.col("lang"), kinds=(nb.BERNOULLI,), labels=REVIEW_CLASSES)
    path = new_path(spark, "model")
    nb.save_model(done.chosen(), path)
    return training.predict_texts(
        documents(spark, sf, "text", "lang"), nb.load_model(spark, path), key="doc_id", language=F.col("lang"))


@query
def nb_gaussian_predict(spark, sf):
    """The third family of models, from sums of counts and of their squares over the same vocabulary."""
    words = materialise(review_words(spark, sf), "words")
    vocab = materialise(tk.vocabulary(words), "vocab")
    model = ct.gaussian_model(ct.count_texts(split_train(words)), vocab=vocab)
    return ct.predict_gaussian(words, replace(model, weights=materialise(model.weights, "weights-gaussian")))


def counted_in_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, ct.TrainingCounts]:
    """Word arrays of the labelled reviews, and their training part counted in three batches and merged."""
    words = materialise(review_words(spark, sf), "words")
    path, parts = new_path(spark, "counts"), ("first", "second", "third")
    for i, name in enumerate(parts):
        own = split_train(words).filter(F.pmod(F.col("id"), F.lit(len(parts))) == i)
        ct.save_counts(ct.count_texts(own), path, name)
    return words, ct.load_counts(spark, path, parts)


@query
def nb_merged_weights(spark, sf):
    """Three batches trained one by one give the weights of training on all of them, vocabulary included."""
    return rounded_weights(ct.model_of(counted_in_parts(spark, sf)[1], nb.BERNOULLI))


@query
def nb_merged_predict(spark, sf):
    """The same for the multinomial and the Gaussian model, down to the predictions."""
    words, merged = counted_in_parts(spark, sf)
    plain = nb.predict(words, nb.materialised(ct.model_of(merged, nb.MULTINOMIAL)))
    gaussian = ct.gaussian_model(merged)
    gaussian = ct.predict_gaussian(words, replace(gaussian, weights=materialise(gaussian.weights, "weights-gaussian")))
    return plain.select(F.lit(nb.MULTINOMIAL).alias("model"), "id", "prediction").unionByName(
        gaussian.select(F.lit(nb.GAUSSIAN).alias("model"), "id", "prediction"))


@query
def nb_model_accuracy(spark, sf):
    done = training.train_and_evaluate(review_words(spark, sf), labels=REVIEW_CLASSES)
    return done.accuracies.select("model", "n", F.round("accuracy", 6).alias("accuracy"))


@query
def nb_train_vocabulary(spark, sf):
    """The leak-free variant: the vocabulary comes from the training part."""
    done = training.train_and_evaluate(review_words(spark, sf), labels=REVIEW_CLASSES, fit_on="train")
    return done.predictions


@query
def train_and_evaluate(spark, sf):
    """The whole experiment: stop words, stems, vocabulary, split, two models, predictions."""
    return training.train_and_evaluate(full_words(spark, sf), labels=REVIEW_CLASSES).predictions


@query
def train_label_counts(spark, sf):
    """Flagship: the whole experiment, reported as predicted labels per model."""
    done = training.train_and_evaluate(full_words(spark, sf), labels=REVIEW_CLASSES)
    return done.predictions.groupBy("model", F.col("prediction").alias("label")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label") == F.col("prediction")).alias("n_right"),
    )


@query
def model_round_trip(spark, sf):
    words, model = fitted(spark, sf, nb.BERNOULLI)
    path = new_path(spark, "model")
    nb.save_model(model, path)
    again = nb.load_model(spark, path)
    return rounded_weights(again).join(again.vocab, "term")


# ---- lexicon ------------------------------------------------------------------------------------


@query
def lexicon_compound(spark, sf):
    return lexicon.plain_scores(documents(spark, sf, "text"), word_valences(spark, sf), "doc_id", "text")


@query
def lexicon_label(spark, sf):
    return lexicon.lexicon_labels(lexicon_compound(spark, sf), key="doc_id")


@query
def lexicon_context(spark, sf):
    return lexicon.context_scores(documents(spark, sf, "text"), word_valences(spark, sf), "doc_id", "text")


@query
def lexicon_context_turns(spark, sf):
    return lexicon.context_scores(turn_texts(spark, sf), word_valences(spark, sf))


# Emoji stand for two frequent words of the turns; each is written out again by a description.
EMOJI = {" the ": "😀 ", " and ": " 🙁"}
EMOJI_DESCRIPTIONS = {"😀": "very the", "🙁": "and not"}


def emoji_texts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("texto")
    for word, emoji in EMOJI.items():
        text = F.replace(text, F.lit(word), F.lit(emoji))
    return turn_texts(spark, sf).select("id", text.alias("texto"))


@query
def emoji_as_words(spark, sf):
    said = lexicon.emoji_as_words(F.col("texto"), EMOJI_DESCRIPTIONS)
    return emoji_texts(spark, sf).select("id", said.alias("texto"))


@query
def lexicon_context_emoji(spark, sf):
    return lexicon.context_scores(
        emoji_texts(spark, sf), word_valences(spark, sf), emoji_descriptions=EMOJI_DESCRIPTIONS)


# ---- external classifier ------------------------------------------------------------------------


@query
def prompt_render(spark, sf):
    return turn_texts(spark, sf).select("id", external.render_prompt(F.col("texto")).alias("prompt"))


@query
def prompt_review(spark, sf):
    return pages(spark, sf).select("page_id", external.review_prompt(F.col("html")).alias("prompt"))


@query
def response_labels(spark, sf):
    texts = turn_texts(spark, sf)
    return external.label_from_responses(texts, responses_for(texts.select("id")), files.MODEL_LABEL)


@query
def response_labels_strict(spark, sf):
    texts = turn_texts(spark, sf)
    return external.label_from_responses(
        texts, responses_for(texts.select("id")), answers.PREDICTION, strict=True
    ).select("id", answers.PREDICTION)


@query
def scorer_map(spark, sf):
    texts = spread(turn_texts(spark, sf), "id")
    return external.score_with(texts, make_keyword_scorer, files.MODEL_LABEL, template=None)


@query
def classify_and_compare(spark, sf):
    texts = turn_texts(spark, sf)
    return classification.classify(
        texts, responses=responses_for(texts.select("id")), lexicon=word_valences(spark, sf), context=False
    )


@query
def answers_kept(spark, sf):
    """Half of the turns in a first run, all in a second one, which asks for new prompts and failed ones only."""
    path, texts = new_path(spark, "answers"), turn_texts(spark, sf)
    answer_store.create_store(spark, path)
    options = {"factory": make_keyword_scorer, "column": files.MODEL_LABEL, "template": None}
    answer_store.score_kept(texts.filter(F.substring(F.md5("id"), 1, 1) < "8"), path, "first", **options)
    return answer_store.score_kept(texts, path, "second", **options).select("id", files.MODEL_LABEL, "run")


# ---- evaluation and summaries -------------------------------------------------------------------


def answered_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """(id, sentiment, prediction): labelled reviews with the strict label of their response."""
    marked = raw_labels(spark, sf).select(
        F.col("doc_id").alias("id"),
        L.map_review_label(F.when(F.col("quality") == 1, "pos").otherwise("neg")).alias("sentiment"),
    )
    return external.label_from_responses(
        marked, responses_for(marked.select("id")), "prediction", strict=True
    )


@query
def answered_only(spark, sf):
    return ev.answered(answered_reviews(spark, sf))


@query
def accuracy_coverage(spark, sf):
    got = ev.accuracy_with_coverage(answered_reviews(spark, sf), "sentiment")
    return got.select(
        "n", "n_answered", F.round("coverage", 6).alias("coverage"),
        F.round("accuracy", 6).alias("accuracy"), L.as_percent(F.col("accuracy")).alias("shown"),
    )


@query
def accuracy(spark, sf):
    got = ev.accuracy(ev.answered(answered_reviews(spark, sf)), "sentiment")
    return got.select(F.round("accuracy", 6).alias("accuracy"))


@query
def confusion(spark, sf):
    return ev.confusion(ev.answered(answered_reviews(spark, sf)), "sentiment")


@query
def classification_report(spark, sf):
    report = ev.classification_report(ev.answered(answered_reviews(spark, sf)), "sentiment")
    measures = ("precision", "recall", "f1_score")
    return report.select("class", *[F.round(m, 6).alias(m) for m in measures], "support")


@query
def head_of_result(spark, sf):
    return ev.head(ev.answered(answered_reviews(spark, sf)))


@query
def unanswered_listing(spark, sf):
    """The listing for a run in which no call succeeded."""
    failed = answered_reviews(spark, sf).withColumn("prediction", F.lit(L.FAILED))
    return ev.unanswered_head(failed, label="sentiment")


@query
def label_counts(spark, sf):
    return summary.label_counts(response_labels(spark, sf), files.MODEL_LABEL)


@query
def label_counts_by_scorer(spark, sf):
    return summary.label_counts_by_scorer(
        classify_and_compare(spark, sf), (files.MODEL_LABEL, files.LEXICON_LABEL)
    )


@query
def table_profile(spark, sf):
    return summary.table_profile(read_table(spark, f"{sf}/documents.parquet"))


@query
def merged_profile(spark, sf):
    """The table profiled in three batches, one by one; their kept sketches merged, the table not read again."""
    path = new_path(spark, "profile")
    table = read_table(spark, f"{sf}/documents.parquet")
    for i, name in enumerate(("first", "second", "third")):
        profile.keep_profile(table.filter(F.pmod("doc_id", F.lit(3)) == i), path, name)
    return profile.merged_profile(profile.kept_profile(spark, path))


@query
def processed_head(spark, sf):
    """The first reviews as they came and as they are trained on: the look at the data before training."""
    words = tk.word_array(F.col("text"), language=F.col("lang"), stop_words=stop_lists(), stem=True)
    first = ev.head(reviews(spark, sf), n=5)
    return first.select("id", "label", "text", X.rejoin(words).alias("processed"))


@query
def text_lengths(spark, sf):
    return summary.text_lengths(read_table(spark, f"{sf}/documents.parquet", "text"), "text")


@query
def row_count(spark, sf):
    return all_posts_to_texts(spark, sf).agg(F.count("*").alias("n"))


# ---- files and streams --------------------------------------------------------------------------


@query
def reviews_csv_scan(spark, sf):
    """Reviews written as a comma-separated file and scanned by name."""
    path = new_path(spark, "reviews")
    rows = reviews(spark, sf).select("id", F.col("text").alias("text_pt"), F.col("label").alias("sentiment"))
    rows.write.options(header=True, quote='"', escape='"').csv(path)
    return files.read_reviews(spark, path)


@query
def csv_round_trip(spark, sf):
    """Raw export read back as a comment file."""
    path = new_path(spark, "raw")
    texts = posts.texts_of_posts(*post_tables(spark, sf))
    files.write_raw_texts(texts, path, "post_id", "pos")
    # Cleaned texts have no line breaks, so these files may be split.
    return files.read_manual_texts(spark, path, multi_line=False)


@query
def raw_export_ids(spark, sf):
    """Raw export with its ids, as written."""
    path = new_path(spark, "raw")
    texts = posts.texts_of_posts(*post_tables(spark, sf))
    files.write_raw_texts(texts, path, "post_id", "pos")
    raw = files.read_csv(spark, path, ("id", files.TEXT_COLUMN), multi_line=False)
    return raw.select(F.col("id").cast("bigint").alias("id"), F.col(f"`{files.TEXT_COLUMN}`").alias("texto"))


@query
def raw_export_by_keyword(spark, sf):
    """Raw export of several searches, one folder per keyword (here: the origin)."""
    path = new_path(spark, "raw-by-keyword")
    texts = posts.texts_of_posts(*post_tables(spark, sf)).withColumnRenamed("origem", "keyword")
    files.write_raw_texts_by_keyword(texts, path, "post_id", "pos")
    raw = files.read_csv(spark, path, ("id", files.TEXT_COLUMN, "keyword"), multi_line=False)
    return raw.select(
        "keyword", F.col("id").cast("bigint").alias("id"), F.col(f"`{files.TEXT_COLUMN}`").alias("texto")
    )


@query
def labelled_file_counts(spark, sf):
    """A labelled file, checked for its columns and counted."""
    path = new_path(spark, "labelled")
    rows = response_labels(spark, sf).withColumnRenamed(files.MODEL_LABEL, "sent_gpt5")
    rows.write.options(sep=files.SEPARATOR, header=True, quote='"', escape='"').csv(path)
    return answers.labelled_file_counts(spark, path, multi_line=False)


@query
def run_search(spark, sf):
    """Search, raw export, labels, results file read back."""
    folder = new_path(spark, "search")
    done = classification.run_search(
        spark, *post_tables(spark, sf), KEYWORD, folder,
        factory=make_keyword_scorer, lexicon=word_valences(spark, sf), context=False,
    )
    written = files.read_csv(spark, done.written_to, ("id", files.TEXT_COLUMN))
    return written.select(
        F.col("id").cast("bigint").alias("id"), "origem",
        F.col(f"`{files.TEXT_COLUMN}`").alias("texto"), files.MODEL_LABEL, files.LEXICON_LABEL,
    )


@query
def run_file(spark, sf):
    """Comment file, labels, results file read back as a comment file."""
    source, folder = new_path(spark, "comments"), new_path(spark, "results")
    files.write_raw_texts(turn_texts(spark, sf), source, "id")
    done = classification.run_file(spark, source, folder, factory=make_keyword_scorer)
    return files.read_manual_texts(spark, done.written_to)


@query
def check_answers(spark, sf):
    """Sampled reviews, a scorer, strict labels."""
    rows = reviews(spark, sf).select("id", F.col("text").alias("text_pt"), F.col("label").alias("sentiment"))
    return answers.check_answers(rows, make_keyword_scorer).sample


def drop_comments(spark: SparkSession, sf: str) -> str:
    folder = new_path(spark, "inbox")
    files.write_raw_texts(turn_texts(spark, sf), folder, "id")
    return folder


@query
def stream_classify(spark, sf):
    """Comment files classified from a drop folder."""
    target, state = new_path(spark, "stream-out"), new_path(spark, "stream-state")
    texts = drop_folder.stream_texts(spark, drop_comments(spark, sf))
    run = drop_folder.classify_folder(
        texts,
        lambda df: external.score_with(df, make_keyword_scorer, files.MODEL_LABEL, template=None),
        target, state,
    )
    run.awaitTermination()
    return spark.read.schema("origem string, texto string, sent_gemini string").parquet(target)


@query
def stream_counts_kept(spark, sf):
    """The same counts, kept as one version per micro-batch, read as the newest."""
    target, state = new_path(spark, "counts-kept"), new_path(spark, "counts-state")
    texts = drop_folder.stream_texts(spark, drop_comments(spark, sf), max_files=4)
    labelled = external.score_with(texts, make_keyword_scorer, files.MODEL_LABEL, template=None)
    drop_folder.keep_counts(labelled, files.MODEL_LABEL, target, state).awaitTermination()
    return drop_folder.read_counts(spark, target)


@query
def stream_label_counts(spark, sf):
    """Running label counts over a drop folder."""
    target, state = new_path(spark, "counts-out"), new_path(spark, "counts-state")
    texts = drop_folder.stream_texts(spark, drop_comments(spark, sf), max_files=4)
    labelled = external.score_with(texts, make_keyword_scorer, files.MODEL_LABEL, template=None)
    drop_folder.count_labels(labelled, files.MODEL_LABEL, target, state).awaitTermination()
    return spark.read.schema(
        T.StructType([T.StructField("label", T.StringType()), T.StructField("n", T.LongType())])
    ).parquet(target)
