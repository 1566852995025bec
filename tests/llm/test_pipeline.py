"""The pipeline against its stages done by hand, each on its own input."""

import hashlib

import pytest
import sentencepiece
from test_operators import PIECES, WORD, brute_components, brute_fingerprint
from test_repeats import brute

import corpus_pipeline
from opinaria.llm import decontaminate
from opinaria.sources.scratch import materialise

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF), "step"))
    return out


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_stages_keep_the_columns_of_documents(steps):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns and df.dtypes == steps[0].dtypes


def test_near_duplicates_stage(steps):
    before, after = by_id(steps[1]), by_id(steps[2])
    parts = brute_components([(d, brute_fingerprint(r["text"])) for d, r in before.items()])
    assert after == {d: r for d, r in before.items() if parts[d] == d}


def test_substring_stage(steps):
    before, after = by_id(steps[2]), by_id(steps[3])
    gone = brute([(d, r["text"]) for d, r in before.items()], lambda t: t.encode().split(), 50, False)
    for d, r in before.items():
        words = [w for i, w in enumerate(WORD.findall(r["text"])) if i not in gone.get(d, ())]
        if d in gone and not words:
            assert d not in after
        else:
            text = " ".join(words) if d in gone else r["text"]
            assert after[d] == r | {"text": text, "n_chars": len(text) if d in gone else r["n_chars"]}


def test_quality_and_benchmark_stages_only_drop_rows(steps, spark):
    for a, b in ((0, 1), (3, 4)):
        before, after = by_id(steps[a]), by_id(steps[b])
        assert all(before[d] == r for d, r in after.items()) and len(after) <= len(before)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r["doc_id"] for r in decontaminate.contaminated(steps[3], items).collect()}
    assert set(by_id(steps[4])) == set(by_id(steps[3])) - hit


def test_encoding_stage_and_run(steps, spark):
    known = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = []
    for d, r in by_id(steps[4]).items():
        ids = known.encode(r["text"] or "")
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), known.decode(ids)))
        expected.append((d, len(ids), *digests))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(expected)


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
