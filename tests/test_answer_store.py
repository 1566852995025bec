"""The answer store asks for new prompts only; stream counts are readable at every moment."""

import os

import pytest

from opinaria.operators import answer_store as store
from opinaria.operators import external, summary
from opinaria.sources import files
from opinaria.streaming import drop_folder

SCHEMA = "id long, texto string"


def counting(log, broken=()):
    """A scorer factory that writes down every call."""

    def make():
        def scorer(prompt):
            with open(log, "a", encoding="utf-8") as f:
                f.write(prompt + "\n")
            if prompt in broken:
                raise RuntimeError("refused")
            return "Positivo." if "bom" in prompt else "negativo"

        return scorer

    return make


def calls(log):
    if not os.path.exists(log):
        return []
    with open(log, encoding="utf-8") as f:
        return sorted(f.read().split("\n")[:-1])


def test_only_new_prompts_and_failed_ones_are_asked(spark, tmp_path):
    path, log = str(tmp_path / "answers"), str(tmp_path / "log")
    store.create_store(spark, path)
    rows = [(1, "bom"), (2, "ruim"), (3, "bom"), (4, None), (5, "falha")]

    def run(name, rows, broken=(), **options):
        texts = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = store.score_kept(texts, path, name, counting(log, broken), "l", template=None, **options)
        assert got.columns == ["id", "texto", "l", "run"]
        return {r["id"]: (r["l"], r["run"]) for r in got.collect()}

    first = run("a", rows, broken=("falha",))
    assert calls(log) == ["bom", "falha", "ruim"]
    assert first == {1: ("positivo", "a"), 2: ("negativo", "a"), 3: ("positivo", "a"), 4: ("nao_classificado", None),
                     5: ("nao_classificado", None)}
    second = run("b", [*rows, (6, "bom dia"), (7, "bom dia"), (8, "ruim")])
    assert calls(log) == sorted(["bom", "falha", "ruim", "falha", "bom dia"])
    assert second == {**first, 5: ("negativo", "b"), 6: ("positivo", "b"), 7: ("positivo", "b"), 8: ("negativo", "a")}
    assert run("c", rows, scorer_name="other")[1] == ("positivo", "c") and len(calls(log)) == 8
    assert run("d", rows)[1] == ("positivo", "a") and len(calls(log)) == 8
    with pytest.raises(Exception, match="(?i)exist"):
        run("d", rows)
    assert run("e", []) == {}


def test_strict_labels_of_kept_answers(spark, tmp_path):
    path, log = str(tmp_path / "answers"), str(tmp_path / "log")
    store.create_store(spark, path)
    texts = spark.createDataFrame([(1, "ruim"), (2, "falha"), (3, "bom")], SCHEMA)
    got = store.score_kept(texts, path, "a", counting(log, ("falha",)), "l", template=None, strict=True)
    assert {r["id"]: r["l"] for r in got.collect()} == {1: "negativo", 2: "erro", 3: "nao_classificado"}


def test_counts_are_complete_at_every_batch(spark, tmp_path):
    inbox, target, state = (str(tmp_path / n) for n in ("inbox", "counts", "state"))
    os.makedirs(inbox)

    def label(df):
        return external.score_with(df, counting(str(tmp_path / "log")), "l", template=None)

    def drop_and_run(name, *texts):
        with open(f"{inbox}/{name}.csv", "w", encoding="utf-8") as f:
            f.write("id;comentario/review\n" + "".join(f"{i};{t}\n" for i, t in enumerate(texts)))
        drop_folder.keep_counts(label(drop_folder.stream_texts(spark, inbox)), "l", target, state).awaitTermination()
        return {r["label"]: r["n"] for r in drop_folder.read_counts(spark, target).collect()}

    assert drop_and_run("a", "bom dia", "ruim") == {"positivo": 1, "negativo": 1}
    assert drop_and_run("b", "bom", "bom fim") == {"positivo": 3, "negativo": 1}
    everything = summary.label_counts(label(files.read_manual_texts(spark, inbox)), "l")
    assert sorted(map(tuple, drop_folder.read_counts(spark, target).collect())) == sorted(map(tuple, everything.collect()))
    old = {r["label"]: r["n"] for r in drop_folder.read_counts(spark, target, 0).collect()}
    assert old == {"positivo": 1, "negativo": 1}
    # A batch that is written again, as after a failure, changes nothing for its readers.
    newest = drop_folder.read_counts(spark, target)
    again = [tuple(r) for r in newest.collect()]
    spark.createDataFrame(again, "label string, n long").coalesce(1).write.mode("overwrite").parquet(f"{target}/batch=1")
    assert sorted(map(tuple, drop_folder.read_counts(spark, target).collect())) == sorted(again)
