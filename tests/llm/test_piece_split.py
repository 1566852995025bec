"""Pieces between spaces: the short way gives the words of the published pattern, and the library's ids."""

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from test_operators import BYTES

from opinaria.llm import arrays as A
from opinaria.llm import pieces, queries, token_files

ODD = ("", " ", "a", " a", "a,", ",", " ,", " a,", "don't", " don't", "'s", " 's", "x's.", "ab!!", " ab)", "a1", " 1.", "é", " été;",
       "ª", " ʰa", "日本", "日本。", "a\nb", "a\n", "\n", "\t\n", "ab.\nCd", "x́y", "ⅷ", " ab$$$", "ß?", "İ", "a　b", "　")


CODER = token_files.PieceEncoder(BYTES)


def test_split_equals_the_pattern():
    for piece in ODD:
        assert list(token_files.split_piece(piece)) == token_files._WORDS.findall(piece), repr(piece)


def test_ids_equal_the_library_also_after_a_cut_of_what_is_remembered(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    coder = token_files.PieceEncoder(BYTES)
    texts = [*ODD, " ".join(ODD), "".join(ODD), "ab ab ab, ab", "one", "one two", "ab.\nCd ab.\nCd " * 50]
    for _ in range(3):
        got = coder.encode(pa.array(texts, pa.string()))
        assert got == [coder.ids(t) for t in texts]


def test_words_of_settled_characters_go_to_the_model_and_others_to_the_library(monkeypatch):
    coder = token_files.PieceEncoder(BYTES)
    plain = ["The words, été ÀÇ ñandú 日本語 привет가! don't 12", "a\nb\tc \x01 ~{}", "x" * 300]
    expected = [coder.ids(t) for t in plain]
    asked, ids = [], coder.ids
    monkeypatch.setattr(coder, "ids", lambda text: asked.append(text) or ids(text))
    assert coder.encode(pa.array(plain)) == expected and not asked
    other = ["ab x\u0301y \U0002ebf0z", "\u0c5dq \u1c89r"]
    assert coder.encode(pa.array(other)) == [ids(t) for t in other] and asked


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t\xa0abTsé'ßıǅɏ09.,!$_ªþ日가жЁЯあア\u0301\x7f\x00\xad")), max_size=4))
def test_ids_of_mixed_characters_equal_the_library(texts):
    assert CODER.encode(pa.array(texts, pa.string())) == [CODER.ids(t) for t in texts]


def test_other_operators_tables_are_given_back():
    """What an encoder remembers must not stay in a worker that goes on to another operator."""
    path = public_tokenizers.path(queries.PIECES)
    pieces.model(path).run("▁word")
    A.give_back(pieces.KEPT)
    assert pieces.model(path).known
    A.give_back()
    assert not A.kept(pieces.KEPT) and not pieces.model(path).known


class Counting:
    """A model that counts what it is asked."""

    def __init__(self, model):
        self.model, self.asked = model, 0

    def tokenize(self, text):
        self.asked += 1
        return self.model.tokenize(text)


def test_many_pieces_go_to_the_model_at_once():
    """One call a word was most of the encoding's time; the words of a piece are kept apart all the same."""
    coder = token_files.PieceEncoder(BYTES)
    coder.model = Counting(coder.model)
    text = " ".join(f"{a}{b}'re.{b}é" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz")
    assert coder.encode(pa.array([text])) == [coder.ids(text)]
    assert coder.model.asked <= 676 // token_files.ASKED_AT_ONCE + 3


def test_what_the_last_texts_used_stays_behind_a_cut(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    coder = token_files.PieceEncoder(BYTES)
    coder.encode(pa.array(["x one two"]))
    coder.encode(pa.array(["x two three four"]))
    assert set(coder.known) == {" x", " two", " three", " four"}


def test_a_vocabulary_that_merges_the_letters_of_ends_is_left_to_the_library(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = list(token_files.byte_letters().values())
    model = models.BPE({t: i for i, t in enumerate([*letters, "aþ", "ab"])}, [("a", "þ"), ("a", "b")])
    made = Tokenizer(model)
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    made.save(str(tmp_path / "small.json"))
    coder = token_files.PieceEncoder(str(tmp_path / "small.json"))
    assert coder.model is None
    texts = ["ab, ab", "a b ab\nab", "Þ þ ÿ"]
    assert coder.encode(pa.array(texts)) == [coder.ids(t) for t in texts]


def test_a_worker_behind_a_task_keeps_the_model_alone(spark):
    """Idle workers that kept words and free memory pushed an executor over its limit in the next job."""
    path = public_tokenizers.path(queries.PIECES)
    table = pieces.model(path)

    class Docs:
        schema = "ignored"

        def select(self, *_):
            return self

        def mapInArrow(self, function, _):
            self.function = function
            return self

    A.kept("another")["x"] = 1
    docs = Docs()
    pieces.digests(docs, path)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one two", None])], names=["_id", "_text"])
    (made,) = docs.function(iter([batch]))
    assert made["n_tokens"].to_pylist()[1] == 0
    assert pieces.model(path) is table and table.rank and not table.known and not table.pairs
    assert not A.kept("another")


def test_tidy_gives_back_behind_the_last_batch_and_on_failure():
    def work(batches):
        for x in batches:
            A.kept("worked")[x] = x
            yield 1 // x

    for batches, error in (([1, 2], None), ([1, 0], ZeroDivisionError)):
        try:
            assert list(A.tidy(work)(iter(batches))) == [1, 0]
        except ZeroDivisionError as got:
            assert error is type(got)
        assert not A.kept("worked")
