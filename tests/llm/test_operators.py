"""Each training-data operator against brute force, library calls, round trips or held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opinaria.llm import (
    classifier, decontaminate, licenses, lm, pieces, planes, queries, rules, simhash, token_files,
)

DATA = Path("/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = (
    None, "", " ", "   ", "a", " a", "a ", "  a  b", "a\nb", "\n", "日本語 テキスト", "😀😀 x", "▁", "a▁b", "▁▁a", "a" * 3000,
    "<s> </s> <unk>", "<0x41>", "\x00x", "a  \n  b ", "x" * 17 + " " * 40 + "y", "ñandú Ünïcödé ﬁ", "<|endoftext|> x",
    "don't  can't", "'s x 's", "a\x1cb \x1c c", "a\x85b", "a  b", "end <|endoftext|>", "X\tY\r\nZ",
)


def odd_rows():
    return [*enumerate(ODD_TEXTS), (None, "no id here"), (3, None), (500, "copy of it"), (500, "copy of it")]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, str(DATA))
    result = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert rows_of(got.select(*names)) == sorted(result.fetchall(), key=str)


# ---- licences -----------------------------------------------------------------------------------


def test_licences_in_other_spelling(texts):
    mit = dict(licenses.KNOWN)["MIT"]
    full = licenses.KNOWN[0][1]
    rows = [
        (1, "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + full.upper().replace(",", " ,")),
        (2, full.replace("sublicense", "sub-license").replace(" ", " \t")),
        (3, "prose\n  *  LICENSED under the Apache Licence, version 2.0\nmore"),
        (4, full + " and more"), (5, None), (6, ""), (7, mit), (7, mit), (None, mit),
    ]
    got = rows_of(licenses.scan(texts(rows)))
    assert got == sorted([
        (1, 0, "MIT"), (2, 0, "MIT"), (3, 2, "Apache-2.0"), *[(7, n, "MIT") for n in (0, 1)] * 2,
        *[(None, n, "MIT") for n in (0, 1)]], key=str)
    assert licenses.scan(texts([], "doc_id long, text string")).count() == 0


# ---- language model -----------------------------------------------------------------------------


def model_rows(rows):
    """Scores by plain dictionaries, from the same counts and the weights learned with exact shares."""
    def tokens(text):
        return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]

    def kind(doc):
        rest = 2 if doc is None else zlib.crc32(str(doc).encode()) % 7
        return {2: lm.HELD_OUT, 3: lm.WEIGHED}.get(rest, lm.COUNTED)

    one, two = defaultdict(Counter), defaultdict(Counter)
    for doc, text in rows:
        if kind(doc) != lm.HELD_OUT:
            t = tokens(text)
            one[kind(doc)].update(t)
            two[kind(doc)].update(zip(["<", *t], t, strict=False))
    counted = one[lm.COUNTED]
    both1, both2 = counted + one[lm.WEIGHED], two[lm.COUNTED] + two[lm.WEIGHED]
    total, distinct = sum(both1.values()), len(both1)

    def quantised(p):
        return 0 if p <= 0 else max(round(lm.STEPS * math.log2(p)), lm.LOWEST) - lm.LOWEST + 1

    table = Counter()
    for doc, text in rows:
        if kind(doc) == lm.WEIGHED:
            t = tokens(text)
            for v, w in zip(["<", *t], t, strict=False):
                c = counted[None if v == "<" else v]
                b = int(lm.bucket_of(np.array([c]))[0])
                p2 = two[lm.COUNTED][(v, w)] / max(c, 1)
                p1 = counted[w] / max(sum(counted.values()), 1)
                table[(b * 1000 + quantised(p2)) * 1000 + quantised(p1)] += 1
    weights = lm.learn_weights(sorted(table.items()), distinct)
    out = []
    for doc, text in rows:
        t = tokens(text)
        base = sum(math.log10((both1[w] + 1) / (total + distinct + 1)) for w in t)
        score = 0.0
        for v, w in zip(["<", *t], t, strict=False):
            c = both1[None if v == "<" else v]
            a = weights[int(lm.bucket_of(np.array([c]))[0])]
            score += math.log10(a[0] * both2[(v, w)] / max(c, 1) + a[1] * both1[w] / max(total, 1) + a[2] / (distinct + 1))
        out.append((doc, kind(doc) == lm.HELD_OUT, len(t), sum(both1[w] > 0 for w in t), total, round(base, 6), round(score, 6)))
    return sorted(out, key=str), weights


def test_lm_like_dictionaries(texts):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(("The cat", "a dog", "the", "sat on it", f"w{rnd.randrange(30)}")) for _ in range(rnd.randrange(40))))
            for i in range(300)] + [(1000, None), (1001, " \t"), (None, "the cat"), (5, "the cat"), (5, "the cat")]
    expected, weights = model_rows(rows)
    got = sorted([(*r[:5], round(r[5], 6), round(r[6], 6)) for r in lm.query(texts(rows)).collect()], key=str)
    assert got == expected
    assert np.allclose(weights.sum(1), 1)
    assert sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1])


def test_lm_empty_and_without_held_out_counts(texts):
    assert lm.query(texts([], "doc_id long, text string")).count() == 0
    assert len(lm.query(texts([(0, "one text"), (1, "two")])).collect()) == 2


# ---- SimHash ------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a[1] ^ prints[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {doc: least[find(i)] for i, (doc, _) in enumerate(prints)}


@pytest.mark.parametrize("block", [512, 8])
def test_simhash_like_brute_force(texts, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(5)
    body = [f"w{rnd.randrange(900)}" for _ in range(300)]
    rows = [(1000, None), (1001, ""), (1002, "One two"), (1003, "one TWO")]
    for i in range(120):
        words = list(body) if i % 3 else [f"v{rnd.randrange(900)}" for _ in range(60)]
        for _ in range(rnd.randrange(6)):
            words[rnd.randrange(len(words))] = "edited"
        rows.append((i, " ".join(words)))
    prints = [(doc, brute_fingerprint(text)) for doc, text in rows]
    parts = brute_components(prints)
    got = {r[0]: tuple(r) for r in simhash.query(texts(rows)).collect()}
    assert got == {doc: (doc, f"{fp:016x}", parts[doc]) for doc, fp in prints}
    assert len(set(parts.values())) < len(rows) - 20


def test_linked_points_share_a_grid_on_every_level():
    """Whatever four segments differ, some grid of each level fixes none of them, below one that does not either."""
    rnd = random.Random(8)
    levels = simhash.grids()
    assert [len(x) for x in levels] == [70, 1050, 15750]
    for _ in range(300):
        differ = set(rnd.sample(range(32), 4))
        first = next(i for i, fixed in enumerate(levels[0]) if not fixed & differ)
        below = [i for i in range(first * 15, first * 15 + 15) if not levels[1][i] & differ]
        assert below and all(levels[0][first] < levels[1][i] for i in below)
        assert any(not levels[2][j] & differ for j in range(below[0] * 15, below[0] * 15 + 15))


@pytest.mark.parametrize("block", [512, 4])
def test_links_of_chosen_fingerprints(spark, monkeypatch, block):
    """Chains at exactly four bits, neighbours at five, both halves of a segment."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(block)
    prints = [0, (1 << 64) - 1]
    for _ in range(12):
        at = rnd.getrandbits(64)
        for _ in range(12):
            bits = rnd.sample(range(64), rnd.choice((1, 2, 4, 4, 5)))
            at ^= sum(1 << b for b in bits)
            prints.append(at)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.components(simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long")))
    root = {r["node"]: r["root"] for r in found.collect()}
    brute = brute_components(list(zip(signed, prints, strict=True)))
    assert {p: root.get(p, p) for p in signed} == brute


def test_keep_one_keeps_columns_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(2, text, "a", 1), (1, text, None, 2), (None, text, "b", 3), (7, "other words here now", "c", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, _id int")
    assert rows_of(simhash.keep_one(df)) == sorted([rows[1], rows[2], rows[3]], key=str)
    assert simhash.query(df.filter("false")).count() == 0


# ---- token files and SentencePiece --------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from([planes.BYTES, planes.BITS]))
def test_planes_round_trip(values, kind):
    array = np.array(values, dtype=np.uint32)
    assert (planes.unpack(planes.pack(array, kind), len(array), kind) == array).all()


@pytest.mark.parametrize("kind,chunk", [(planes.BYTES, 1_000_000), (planes.BITS, 7)])
def test_token_files_round_trip(spark, texts, tmp_path, monkeypatch, kind, chunk):
    monkeypatch.setattr(token_files, "CHUNK", chunk)
    rows = [*odd_rows(), (77, " ".join(f"word{i}" for i in range(200)))]
    token_files.write(texts(rows), str(tmp_path / "ids"), BYTES, kind=kind)
    got = token_files.read(spark, str(tmp_path / "ids")).collect()
    known = Tokenizer.from_file(BYTES)
    expected = sorted(((doc, np.array([*known.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
                       for doc, text in rows), key=str)
    assert sorted(((r["doc_id"], bytes(r["ids"])) for r in got), key=str) == expected
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert ids == sorted(ids)


def test_token_query_and_empty_table(texts):
    rows = [(2, "b b"), (1, "a")]
    got = {r[0]: tuple(r) for r in token_files.query(texts(rows), BYTES).collect()}
    known = Tokenizer.from_file(BYTES)
    ids = {doc: [*known.encode(t, add_special_tokens=False).ids, 2] for doc, t in rows}
    assert got == {doc: (doc, 0 if doc == 1 else len(ids[1]), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for doc, i in ids.items()}
    assert token_files.query(texts([], "doc_id long, text string"), BYTES).count() == 0


def test_pieces_like_the_library(texts):
    known = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = odd_rows()
    expected = []
    for doc, text in rows:
        ids = known.encode(text or "")
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), known.decode(ids)))
        expected.append((doc, len(ids), *digests))
    assert rows_of(pieces.query(texts(rows), PIECES)) == sorted(expected, key=str)
    assert pieces.query(texts([], "doc_id long, text string"), PIECES).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" abcdehlnorstTH.,é日▁\n0"), max_size=40))
def test_prefix_table_equals_merging(text):
    known = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = known.encode(text)
    assert pieces.model(PIECES).encode(pa.array([text])) == [(len(ids), ",".join(map(str, ids)), known.decode(ids))]


# ---- classifier and rules -----------------------------------------------------------------------


def test_classifier_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries.op6_quality_classifier(spark, folder).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    seen = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in seen) / len(seen) > 0.95


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 2.0), (2, "", 1.0), (None, "x" * 9000, None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (9, 1)], "doc_id long, quality int")
    got = classifier.query(docs, labels).collect()
    assert len(got) == 3 and all(r["predicted"] == 1 for r in got)
    assert classifier.query(docs.filter("false"), labels.filter("false")).count() == 0
    assert rows_of(classifier.keep_good(docs, labels)) == rows_of(docs)


def brute_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    repeats = len(covered)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeats,
            len(words) < 50 or 100 * repeats > 50 * len(words))


def test_rules_like_brute_force(spark):
    rnd = random.Random(6)
    rows = [(i, t, "en", None) for i, t in odd_rows()]
    for i in range(400):
        words = [rnd.choice("the of a in".split()) + (str(rnd.randrange(400)) if rnd.random() < 0.9 else "") for _ in range(rnd.randrange(30, 120))]
        if i % 40 == 0:
            words = [w + "***" for w in words]
        text = " ".join(words)
        if i % 50 == 1:
            text = "\n".join([text[:80]] * 6 + [text])
        rows.append((2000 + i, text, rnd.choice(["en", "de", None]), "src0" if i % 3 else f"src{i % 7}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = rules.query(df).collect()
    by_id = {(i, t): brute_counts(t) for i, t, _, _ in rows}
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(((i, *by_id[(i, t)]) for i, t, _, _ in rows), key=str)
    verdict = {r["doc_id"]: r["kept"] for r in got}
    assert not any(r["kept"] and r["base_failed"] for r in got)
    judged = [(i, t) for i, t, _, _ in rows if i and i >= 2000 and not by_id[(i, t)][5]]
    junk = [i for i, t in judged if by_id[(i, t)][2] > 10]
    assert junk and not any(verdict[i] for i in junk)
    clean = [i for i, t in judged if by_id[(i, t)][2] == 0 and by_id[(i, t)][3] == 0 and by_id[(i, t)][4] == 0]
    assert clean and all(verdict[i] for i in clean)
    plan = rules.judged(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Nested" not in plan and "Cartesian" not in plan
    assert rules.query(df.filter("false")).count() == 0


# ---- decontamination ----------------------------------------------------------------------------

ITEM = "A train leaves Paris at 9 and travels 120 km to Lyon while another train leaves Lyon at 11 heading for Paris."


def test_templates_with_other_values(spark, texts):
    other = "Yesterday: a train leaves Rome at 7 and travels 300 miles to Turin while another train leaves Turin at 10 heading for Rome."
    mixed = "So a train leaves Rome at 7 and travels 300 miles to Turin while another train leaves Milan at 10 heading for Rome."
    items = spark.createDataFrame([(1, ITEM), (2, "Name the red fox quickly."), (3, None), (4, ""), (None, ITEM), (5, "Two words")],
                                  "item_id long, text string")
    rows = [
        (1, "Some prose first. " + ITEM + " And more."), (2, ITEM.upper()), (3, other), (4, mixed), (5, None), (6, ""),
        (7, "please name the RED fox, quickly now"), (8, "two words of little use and nothing else at all in here"),
        (9, " ".join(ITEM.split()[:10])), (None, ITEM), (1, ITEM),
        (10, "intro words " + " ".join(ITEM.split()[3:18]) + " outro words"),
    ]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(texts(rows), items).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (7, 2), (10, 1)}
    assert got[(1, 1)]["exact"] and not got[(3, 1)]["exact"] and got[(3, 1)]["n_slots"] == 6
    again = decontaminate.contaminated(texts(rows), items, most_sifted=0).collect()
    assert rows_of(decontaminate.contaminated(texts(rows), items)) == sorted(map(tuple, again), key=str)
    kept = decontaminate.keep_clean(texts(rows), items)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [4, 5, 6, 8, 9]
    assert decontaminate.contaminated(texts([], "doc_id long, text string"), items).count() == 0
    assert decontaminate.contaminated(texts(rows), items.filter("false")).count() == 0


def test_planted_passages_of_the_benchmark(spark):
    folder = "/root/testdata/sf0.01"
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], " ".join(WORD.findall(r["text"] or ""))) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    whole = {(d, i) for i, text in items if len(text.split()) >= 5 for d, body in docs if " ".join(text.split()) in body}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op9_decontamination(spark, folder).collect()}
    assert whole and whole <= got


def test_totals_of_words_beyond_32_bits():
    """Three slices that each hold a word as often as 32 bits can say."""
    most, keys = (1 << 32) - 1, np.array([5, 9], dtype=np.uint64)
    rows = [{"part": 0, "slice": i, "kind": kind, "n1": 2, "keys1": lm.pack_keys(keys), "c1": lm.pack_counts(np.array([most, 1])),
             "n2": 0, "keys2": [], "c2": []} for i, kind in enumerate((lm.COUNTED, lm.COUNTED, lm.WEIGHED))]
    planes_of = pa.list_(pa.binary())
    table = pa.table({c: pa.array([r[c] for r in rows], planes_of if c[0] in "kc" and c != "kind" else pa.int64()) for c in rows[0]})
    done = lm.add_up(table).to_pylist()
    assert [planes.unpack(r["counted1"], 2).tolist() for r in done[:3]] == [[2 * most, 2]] * 3
    assert [planes.unpack(r["weighed1"], 2).tolist() for r in done[:3]] == [[most, 1]] * 3
    assert done[3]["stats"] == [2 * most + 2, 3 * most + 3, 2]


def test_packets_never_outnumber_the_keys(texts):
    """However many parts there are, a slice sends rows only to those it has keys of; the totals are the same."""
    docs = texts([(i, f"the {i} cat{i % 7} sat") for i in range(50)]).select(
        F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.lit(lm.COUNTED).alias("_kind"))
    made = lm.written(lm.slices(docs.coalesce(1)), "packets-test")
    payload = bytes(made.first()["payload"])
    tokens = lm.Tokens(payload)
    for parts in (1, 3, 64, 100_000):
        rows = lm.packets(made, parts).collect()
        assert len(rows) <= min(parts, len(tokens.words) + len(tokens.pairs))
        rows.sort(key=lambda r: r["part"])
        for n, keys, counts, whole, at in (("n1", "keys1", "c1", tokens.words, tokens.word_at),
                                           ("n2", "keys2", "c2", tokens.pairs, tokens.pair_at)):
            assert np.concatenate([lm.unpack_keys(r[keys], r[n]) for r in rows]).tolist() == whole.tolist()
            assert np.concatenate([lm.unpack_counts(r[counts]) for r in rows]).tolist() == np.bincount(at).tolist()


@pytest.mark.parametrize("size", [0, 1, lm.LEAST_PLANES - 1, lm.LEAST_PLANES, 1000])
@pytest.mark.parametrize("most", [1, 255, 256, 1 << 16, 1 << 32, 1 << 62])
def test_packed_keys_and_counts_come_back(size, most):
    rnd = random.Random(size)
    keys = np.array(sorted({rnd.getrandbits(64) for _ in range(size)}), dtype=np.uint64)
    counts = np.array([rnd.randint(1, most) for _ in range(size)], dtype=np.int64)
    assert lm.unpack_keys(lm.pack_keys(keys), size).tolist() == keys.tolist()
    assert lm.unpack_counts(lm.pack_counts(counts)).tolist() == counts.tolist()


def test_weights_are_learned_from_their_own_slices_totals_alone(texts):
    """Totals name their slice's kind, so that the other slices' need not be moved to learn the weights."""
    docs = texts([(i, f"the {i} cat{i % 7} sat") for i in range(60)]).select(
        F.col("doc_id").alias("_id"), F.col("text").alias("_text"), (F.col("doc_id") % 3).cast("int").alias("_kind"))
    made = lm.written(lm.slices(docs), "kinds-test")
    totals = lm.written(lm.packets(made, 4).groupBy("part").applyInArrow(lm.add_up, lm.TOTALS), "kinds-totals")
    own = totals.filter(F.col("kind") == lm.WEIGHED)
    assert {r["slice"] for r in own.collect()} == {r["slice"] for r in made.filter(F.col("kind") == lm.WEIGHED).collect()}
    assert own.count() < totals.filter("slice IS NOT NULL").count()
    names = ("counted1", "counted2")
    weighed = made.filter(F.col("kind") == lm.WEIGHED)
    few, all_ = (sorted(map(str, lm.with_totals(weighed, t, names).collect())) for t in (own, totals))
    assert few and few == all_
