import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opinaria.functions import labels as L
from opinaria.functions import text as X


def test_tags_are_deleted_or_spaced(apply):
    values = ["a<br>b", "<a\nb>", "x < y", "<p>um</p>", None]
    assert apply(X.strip_tags, values) == ["ab", "<a\nb>", "x < y", "um", None]
    assert apply(lambda c: X.strip_tags(c, " "), values)[0] == "a b"


def test_clean_text_edge_rows(apply):
    values = [
        "a<br>b", "<a\nb>", "http://x.y/z fim", "HTTP://X fim", None, "", "<i></i>", "https://so.url",
        "um dois\x1ctres\rquatro", "  fora  ",
    ]
    assert apply(X.clean_text, values) == [
        "a b", "<a b>", "fim", "HTTP://X fim", "", "", "", "", "um dois tres quatro", "fora",
    ]


def python_clean(text):
    text = re.sub(r"<.*?>", " ", text)
    text = re.sub(r"https?://\S+", " ", text)
    return re.sub(r"\s+", " ", text.replace("\n", " ")).strip()


def test_clean_text_equals_the_rule_on_generated_text(apply):
    pieces = st.sampled_from(
        ["<", ">", "<b>", "http://", "https://a", " ", "\n", "\r", "\t", "\x0b", "\x1f", "\x85", " ",
         "　", "é", "ação", "😀", "a", "/", "."]
    )
    texts = []

    @settings(max_examples=400, database=None, deadline=None)
    @given(st.lists(pieces, max_size=14))
    def gather(parts):
        texts.append("".join(parts))

    gather()
    got = apply(X.clean_text, texts)
    assert got == [python_clean(t) for t in texts]
    for text in got:
        assert "  " not in text and text == text.strip()


def test_special_characters(apply):
    values = ["é ótimo! 😀 ção", "éa", "a_b-c"]
    assert apply(X.spaces_for_specials, values) == ["é ótimo    ção", "e a", "a b c"]
    assert apply(X.normalise, ["<b>ÓTIMO</b> Já!"]) == ["ótimo já "]


def test_tokens(apply):
    values = ["Filme RUIM,  muito-ruim!", "", None, "!!!", "I cannot, gonna go; cannotx"]
    assert apply(X.tokens, values) == [
        ["filme", "ruim", "muito", "ruim"], [], [], [],
        ["i", "can", "not", "gon", "na", "go", "cannotx"],
    ]


def test_stop_words_keep_repeats_and_order(apply):
    dropped = apply(lambda c: X.rejoin(X.drop_words(X.tokens(c), ["o", "de"])), ["o bom de bom o", "o de"])
    assert dropped == ["bom bom", ""]


def test_preview_boundary(apply):
    short, long = "x" * 180, "x" * 181
    assert apply(X.preview, [short, long, "", None]) == [short, "x" * 180 + "…", "", None]


def test_label_rules(apply):
    answers = [" Positivo.", "NEGATIVO", "neutra", "neither", "", None, "positivo e negativo"]
    assert apply(L.normalise_label, answers) == [
        "positivo", "negativo", "neutro", "neutro", "nao_classificado", "nao_classificado", "positivo",
    ]
    assert apply(lambda c: L.strict_label(c, F.lit(False)), [*answers, " positivo\n", " Negativo"]) == [
        "nao_classificado", "negativo", "nao_classificado", "nao_classificado", "nao_classificado", "erro",
        "nao_classificado", "positivo", "negativo",
    ]
    assert apply(lambda c: L.strict_label(c, F.lit(True)), ["positivo"]) == ["erro"]
    assert apply(L.map_review_label, ["pos", "neg", "other", None]) == ["positivo", "negativo", None, None]


def test_thresholds_and_percent(apply):
    scores = [0.05, -0.05, 0.049, -0.049, 0.0]
    assert apply(L.label_from_compound, scores, "double") == [
        "positivo", "negativo", "neutro", "neutro", "neutro",
    ]
    assert apply(L.as_percent, [0.5, 1 / 3], "double") == ["50.00%", "33.33%"]
