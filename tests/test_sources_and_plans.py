import csv
import os

import pytest
from pyspark.sql import functions as F

from opinaria.functions import labels as L
from opinaria.operators import evaluate as ev
from opinaria.operators import external, summary
from opinaria.operators import naive_bayes as nb
from opinaria.plans import answers, classification
from opinaria.sources import files, posts, scratch, tables
from opinaria.streaming import drop_folder

LABELLED_HEADER = "id;origem;texto;sent_gpt5\n"
TEXTS = ["Muito bom; mesmo", 'ele disse "sim"', "duas\nlinhas", " com espaço  ", "fim"]


def answer_by_word():
    def scorer(text):
        if "falha" in text:
            raise RuntimeError
        return "Positivo!" if "bom" in text else "negativo" if "ruim" in text else None

    return scorer


def text_rows(spark, values):
    return spark.createDataFrame(list(enumerate(values, 1)), "id bigint, texto string").withColumn("origem", F.lit("manual"))


# ---- files --------------------------------------------------------------------------------------


def test_raw_export_is_read_back(spark, tmp_path):
    path = str(tmp_path / "raw")
    assert files.write_raw_texts(text_rows(spark, TEXTS), path, "id")
    got = {r["texto"] for r in files.read_manual_texts(spark, path).collect()}
    assert got == {'Muito bom; mesmo', 'ele disse "sim"', "duas linhas", "com espaço", "fim"}
    raw = files.read_csv(spark, path, ("id",)).collect()
    assert sorted((int(r["id"]), r["comentario/review"]) for r in raw) == list(enumerate(TEXTS, 1))


def test_other_csv_readers_understand_the_export(spark, tmp_path):
    path = tmp_path / "raw"
    files.write_raw_texts(text_rows(spark, TEXTS), str(path), "id")
    rows = []
    for part in sorted(path.glob("part-*.csv")):
        with open(part, newline="", encoding="utf-8") as f:
            rows += list(csv.DictReader(f, delimiter=";"))
    assert sorted((int(r["id"]), r["comentario/review"]) for r in rows) == list(enumerate(TEXTS, 1))


def test_nothing_is_written_for_no_rows(spark, tmp_path):
    empty = text_rows(spark, TEXTS).filter("id < 0").withColumn("keyword", F.lit("x"))
    path = str(tmp_path / "none")
    assert not files.write_raw_texts(empty, path, "id")
    assert not files.write_raw_texts_by_keyword(empty, path, "id")
    assert not files.write_results(empty.withColumn("sent_gemini", F.lit("x")), path, "id")
    assert not os.path.exists(path)


@pytest.mark.parametrize("lexicon", [False, True])
def test_results_layout_and_closed_loop(spark, tmp_path, lexicon):
    rows = text_rows(spark, ["b", "a"]).withColumn("sent_gemini", F.lit("neutro"))
    if lexicon:
        rows = rows.withColumn("sent_vader", F.lit("neutro"))
    path = str(tmp_path / "results")
    files.write_results(rows, path, "texto")
    back = files.read_csv(spark, path, ())
    optional = ["sent_vader"] if lexicon else []
    assert back.columns == ["id", "origem", "comentario/review", "sent_gemini", *optional]
    assert sorted((r["id"], r["comentario/review"]) for r in back.collect()) == [("1", "a"), ("2", "b")]
    assert {r["texto"] for r in files.read_manual_texts(spark, path).collect()} == {"a", "b"}


def test_missing_columns_are_an_error(spark, tmp_path):
    source = tmp_path / "x.csv"
    source.write_text("ID;Texto\n1;oi\n", encoding="utf-8")
    with pytest.raises(ValueError, match="comentario/review"):
        files.read_manual_texts(spark, str(source))
    with pytest.raises(ValueError, match="origem.*sent_gpt5.*texto"):
        files.read_labelled(spark, str(source))
    assert files.read_manual_texts(spark, str(source), "Texto").collect() == [("manual", "oi")]


def test_reviews_are_read_by_name(spark, tmp_path):
    source = tmp_path / "r.csv"
    source.write_text('id,text_en,text_pt,sentiment\n1,"a, b","dois\nversos ""x""",pos\n2,c,d,neg\n', encoding="utf-8")
    got = sorted(map(tuple, files.read_reviews(spark, str(source)).collect()))
    assert got == [("d", "neg"), ('dois\nversos "x"', "pos")]


def test_orphan_rows_count_as_labels_but_are_no_texts(spark, tmp_path):
    source = tmp_path / "l.csv"
    source.write_text(
        LABELLED_HEADER + '1;manual;"A fila ""anda"" bem";positivo\n2;manual;Demora demais;negativo\n'
        "resto de uma frase cortada;;;neutro\n3;manual;Abre amanhã;neutro\n", encoding="utf-8")
    counts = {r["label"]: r["n"] for r in answers.labelled_file_counts(spark, str(source)).collect()}
    assert counts == {"neutro": 2, "positivo": 1, "negativo": 1}
    kept = summary.drop_empty(files.read_labelled(spark, str(source)))
    assert {r["label"]: r["n"] for r in summary.label_counts(kept, "sent_gpt5").collect()} == {
        "neutro": 1, "positivo": 1, "negativo": 1}


def test_output_names():
    assert files.raw_output_name(" gripe ") == "reddit_gripe_raw.csv"
    assert files.results_output_name("gripe") == "reddit_gripe_results.csv"
    assert files.file_results_name("/a/b/dados.csv") == "dados_results.csv"
    with pytest.raises(ValueError):
        files.raw_output_name("  ")


def test_small_scans_are_spread(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).withColumn("x", F.lit(1)).coalesce(1).write.parquet(path)
    table = tables.read_table(spark, path, "id")
    assert table.columns == ["id"]
    assert tables.spread(table, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 16)
    assert tables.spread(wide, "id") is wide


def test_scratch_folder_is_the_configured_one(spark):
    assert scratch.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


# ---- posts --------------------------------------------------------------------------------------


@pytest.fixture
def post_tables(spark):
    titles = [(1, "Posto ABERTO hoje"), (2, ""), (3, "aberto?"), (4, None), (5, "<b></b>"), (6, "Fechado")]
    comments = [(1, i, f"comentário {i}") for i in range(1, 8)] + [(2, 1, "sem título"), (3, 1, "  "), (6, 1, "ok")]
    return (
        spark.createDataFrame(titles, "post_id bigint, title string"),
        spark.createDataFrame(comments, "post_id bigint, pos int, body string").repartition(3),
    )


def test_posts_to_texts(post_tables):
    rows = {(r["post_id"], r["pos"]): (r["origem"], r["texto"]) for r in posts.texts_of_posts(*post_tables).collect()}
    assert rows == {
        (1, 0): ("titulo", "Posto ABERTO hoje"), **{(1, i): ("comentario", f"comentário {i}") for i in range(1, 6)},
        (2, 1): ("comentario", "sem título"), (3, 0): ("titulo", "aberto?"), (6, 0): ("titulo", "Fechado"),
        (6, 1): ("comentario", "ok"),
    }


def test_keyword_search(post_tables):
    assert {r["post_id"] for r in posts.collect_texts(*post_tables, " Aberto ").collect()} == {1, 3}
    assert {r["post_id"] for r in posts.collect_texts(*post_tables, "aberto", post_limit=1).collect()} == {1}
    with pytest.raises(ValueError):
        posts.collect_texts(*post_tables, " ")


def test_nested_posts_give_the_same_texts(spark, post_tables):
    titles, comments = post_tables
    nested = titles.join(
        comments.groupBy("post_id").agg(F.collect_list(F.struct("pos", "body")).alias("comments")), "post_id", "left")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(posts.texts_of_nested_posts(nested)) == key(posts.texts_of_posts(*post_tables))
    assert key(posts.collect_nested_texts(nested, "aberto")) == key(posts.collect_texts(*post_tables, "aberto"))


# ---- external classifier ------------------------------------------------------------------------


def test_prompt_takes_text_literally(apply):
    got = apply(external.render_prompt, ['a {texto} $1 \\ "x"'])[0]
    assert got == external.THREE_CLASS_PROMPT.replace("{texto}", 'a {texto} $1 \\ "x"', 1)


def test_failed_calls_mark_their_own_row(spark):
    df = text_rows(spark, ["bom", "ruim", "falha", "outro"])
    lenient = external.score_with(df, answer_by_word, "l")
    assert {r["texto"]: r["l"] for r in lenient.collect()} == {
        "bom": L.POSITIVE, "ruim": L.NEGATIVE, "falha": L.UNCLASSIFIED, "outro": L.UNCLASSIFIED}
    strict = external.score_with(df, answer_by_word, "l", template=None, strict=True)
    assert {r["texto"]: r["l"] for r in strict.collect()} == {
        "bom": L.UNCLASSIFIED, "ruim": L.NEGATIVE, "falha": L.FAILED, "outro": L.FAILED}


def test_missing_response(spark):
    df = text_rows(spark, ["a", "b", "c"])
    responses = spark.createDataFrame([(1, "positivo", False), (2, "positivo", True)], "id bigint, answer string, error boolean")
    for strict, rest in ((False, L.UNCLASSIFIED), (True, L.FAILED)):
        got = external.label_from_responses(df, responses, "l", strict=strict)
        assert {r["id"]: r["l"] for r in got.collect()} == {1: L.POSITIVE, 2: rest, 3: rest}


# ---- evaluation ---------------------------------------------------------------------------------


def test_split_is_disjoint_complete_and_stable(spark):
    df = spark.range(4000)
    train, test = ev.split(df)
    a, b = {r[0] for r in train.collect()}, {r[0] for r in test.collect()}
    assert not a & b and a | b == set(range(4000))
    assert 0.17 < len(b) / 4000 < 0.23
    again = ev.split(df.repartition(7).filter("id % 2 = 0"))[1]
    assert {r[0] for r in again.collect()} == {i for i in b if i % 2 == 0}
    assert ev.split(df, share=1.0)[0].count() == 0 and ev.split(df, share=0.0)[1].count() == 0


def test_sample_is_exact(spark):
    assert ev.sample_rows(spark.range(100)).count() == 10
    assert ev.sample_rows(spark.range(4)).count() == 4
    assert ev.sample_rows(spark.range(100)).collect() != ev.sample_rows(spark.range(100), seed=1).collect()


def test_report(spark):
    pairs = [("p", "p")] * 3 + [("p", "n")] + [("n", "n")] * 2 + [("n", "x")]
    df = spark.createDataFrame(pairs, "label string, prediction string")
    got = {r["class"]: r for r in ev.classification_report(df).collect()}
    assert set(got) == {"p", "n", "x", "accuracy", "macro avg", "weighted avg"}
    assert (got["p"]["precision"], got["p"]["recall"], got["p"]["support"]) == (1.0, 0.75, 4)
    assert got["n"]["f1_score"] == pytest.approx(2 / 3)
    assert (got["x"]["precision"], got["x"]["recall"], got["x"]["f1_score"], got["x"]["support"]) == (0, 0, 0, 0)
    assert got["accuracy"]["f1_score"] == pytest.approx(5 / 7) and got["accuracy"]["precision"] is None
    assert got["macro avg"]["recall"] == pytest.approx((0.75 + 2 / 3) / 3)
    assert got["weighted avg"]["precision"] == pytest.approx((4 * 1.0 + 3 * 2 / 3) / 7)
    assert ev.classification_report(df.filter("label = 'zzz'")).count() == 0


def test_nothing_answered(spark):
    df = spark.createDataFrame([(2, "positivo", "erro"), (1, "negativo", "nao_classificado")], "id int, label string, prediction string")
    assert ev.accuracy_with_coverage(df).count() == 0
    assert [r["id"] for r in ev.unanswered_head(df).collect()] == [1, 2]
    one = df.union(spark.createDataFrame([(3, "positivo", "negativo")], df.schema))
    assert ev.unanswered_head(one).count() == 0
    assert ev.accuracy_with_coverage(one).collect()[0].asDict() == {
        "n": 3, "n_answered": 1, "coverage": pytest.approx(1 / 3), "accuracy": 0.0}


def test_label_counts_add_up_and_skip_null(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", None), (None, "y")], "sent_gemini string, sent_vader string")
    assert [tuple(r) for r in summary.label_counts(df, "sent_gemini").collect()] == [("a", 2), ("b", 1)]
    both = summary.label_counts_by_scorer(df, ("sent_gemini", "sent_vader", "absent"))
    assert sum(r["n"] for r in both.collect()) == 6


def test_profile(spark):
    df = spark.createDataFrame([("a", None), ("b", 1)], "`comentario/review` string, n int")
    assert [tuple(r) for r in summary.table_profile(df).collect()] == [
        ("comentario/review", "string", 2, 2), ("n", "int", 2, 1)]


# ---- plans --------------------------------------------------------------------------------------


def test_search_plan(spark, post_tables, tmp_path):
    lexicon = spark.createDataFrame([("aberto", 2.0)], "term string, valence double")
    done = classification.run_search(spark, *post_tables, "aberto", str(tmp_path), factory=answer_by_word, lexicon=lexicon)
    assert sorted(os.listdir(tmp_path)) == ["reddit_aberto_raw.csv", "reddit_aberto_results.csv"]
    assert {r["sent_vader"] for r in done.rows.filter("origem = 'titulo'").collect()} == {L.POSITIVE}
    assert sum(r["n"] for r in done.counts().collect()) == 2 * done.rows.count() == 14
    assert done.table(L.ALL_LABELS).count() == 7 and done.table(L.POSITIVE).count() == 0
    none = classification.run_search(spark, *post_tables, "inexistente", str(tmp_path), factory=answer_by_word)
    assert none.written_to is None and len(os.listdir(tmp_path)) == 2


def test_file_plan_without_lexicon(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text("id;comentario/review\n1;bom\n2;\n3;ruim demais\n", encoding="utf-8")
    done = classification.run_file(spark, str(source), str(tmp_path), factory=answer_by_word)
    assert done.written_to.endswith("in_results.csv")
    back = files.read_csv(spark, done.written_to, ("id",)).collect()
    assert sorted(map(tuple, back)) == [("1", "manual", "bom", "positivo"), ("2", "manual", "ruim demais", "negativo")]
    with pytest.raises(ValueError):
        classification.classify(done.rows)


def test_answer_check_plan(spark):
    rows = [(i, "muito <i>ruim</i>" if i % 2 else "falha", "neg") for i in range(40)]
    check = answers.check_answers(spark.createDataFrame(rows, "id bigint, text_pt string, sentiment string"), answer_by_word, n=20)
    coverage = check.coverage().collect()[0]
    assert coverage["n"] == 20 and coverage["accuracy"] == 1.0 and 0 < coverage["n_answered"] < 20
    assert check.examples().count() == min(10, coverage["n_answered"]) and check.unanswered().count() == 0
    assert {r["class"] for r in check.report().collect()} == {"negativo", "accuracy", "macro avg", "weighted avg"}


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    inbox, target, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    os.makedirs(inbox)

    def drop(name, *texts):
        with open(f"{inbox}/{name}.csv", "w", encoding="utf-8") as f:
            f.write("id;comentario/review\n" + "".join(f"{i};{t}\n" for i, t in enumerate(texts)))

    def classify(df):
        return external.score_with(df, answer_by_word, "sent_gemini", template=None)

    def run():
        texts = drop_folder.stream_texts(spark, inbox, max_files=1)
        drop_folder.classify_folder(texts, classify, target, state).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(target).collect())

    drop("a", "bom dia", "ruim", "<b></b>")
    drop("b", "falha")
    batch = classify(files.read_manual_texts(spark, inbox))
    assert run() == sorted(tuple(r) for r in batch.collect())
    drop("c", "bom fim")
    assert len(run()) == 4
    counts, cstate = str(tmp_path / "counts"), str(tmp_path / "cstate")
    labelled = classify(drop_folder.stream_texts(spark, inbox, max_files=1))
    drop_folder.count_labels(labelled, "sent_gemini", counts, cstate).awaitTermination()
    everything = classify(files.read_manual_texts(spark, inbox))
    assert sorted(map(tuple, spark.read.parquet(counts).collect())) == sorted(
        map(tuple, summary.label_counts(everything, "sent_gemini").collect()))


def test_csv_is_read_by_name(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text("id;comentario/review\n1;um bom filme\n", encoding="utf-8")
    assert files.read_manual_texts(spark, str(folder)).count() == 1
    (folder / "b.csv").write_text("id;origem;comentario/review\n1;titulo;um bom filme\n", encoding="utf-8")
    with pytest.raises(Exception, match="CSV header|column"):
        files.read_manual_texts(spark, str(folder)).collect()
    parts = tmp_path / "parts" / "keyword=007"
    parts.mkdir(parents=True)
    (parts / "a.csv").write_text("id;comentario/review\n1;um bom filme\n", encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "parts"), ("keyword",)).collect()
    assert [r["keyword"] for r in got] == ["007"]


def test_a_lexicon_does_not_ask_the_scorer_again(spark):
    texts = spark.createDataFrame([(i, "titulo", f"bom {i}") for i in range(20)], "id long, origem string, texto string")
    lexicon = spark.createDataFrame([("bom", 2.0)], "term string, valence double")
    rows = classification.classify(texts, factory=lambda: lambda prompt: "positivo", lexicon=lexicon)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert rows.count() == 20


def test_no_class_is_cut(spark):
    terms = spark.createDataFrame([(f"t{i:04}", i) for i in range(3000)], "term string, term_idx int")
    rows = spark.createDataFrame([("a", ["t0001"])], "label string, words array<string>")
    with pytest.raises(ValueError):
        nb.fit(rows, vocab=terms, labels=[f"c{i}" for i in range(nb.MAX_CLASSES + 1)])


def test_sinks_run_the_plan_of_their_input_no_more_than_the_sort_does(spark, tmp_path):
    """The sort looks at its input once for its bounds and once to move it; asking for emptiness adds no run."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(20, numPartitions=2).selectExpr("CAST(id AS string) AS texto")
    df = df.mapInArrow(counted, df.schema)
    assert files.write_raw_texts(df, str(tmp_path / "raw"), "texto")
    assert seen.value <= 40
    assert not files.write_raw_texts(df.limit(0), str(tmp_path / "none"), "texto")
    assert not os.path.exists(tmp_path / "none")
