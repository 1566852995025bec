"""Portuguese suffix stemmer (the published Snowball rules) for word arrays and word columns.

Spark has no stemmer. The rules are a small Python function here; what feeds it is Arrow. A batch of
word arrays is dictionary-encoded, each distinct word of the batch is stemmed once, and the stems
are put back by index. So the Python work grows with the distinct words of a task, not with its
text, and the step stays narrow: no join with a vocabulary and no shuffle of words.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Vowels and suffix lists of the published algorithm, with ã and õ written a~ and o~.
VOWELS = "aeiouáéíóúâêô"
STEP1_DELETE = (
    "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas "
    "amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância"
).split()
STEP1_LOG = "logia logias".split()
STEP1_U = "uça~o uço~es".split()
STEP1_ENTE = "ência ências".split()
STEP1_AMENTE = "amente".split()
STEP1_MENTE = "mente".split()
STEP1_IDADE = "idade idades".split()
STEP1_IVO = "iva ivo ivas ivos".split()
STEP1_IRA = "ira iras".split()
AFTER_AMENTE = "(?:(?:at)?iv|os|ic|ad)$"
AFTER_MENTE = "(?:ante|avel|ível)$"
AFTER_IDADE = "(?:abil|ic|iv)$"
AFTER_IVO = "at$"
STEP2_DELETE = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei "
    "irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido "
    "ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás "
    "eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais "
    "eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis "
    "ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos "
    "eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
).split()
STEP4_DELETE = "os a i o á í ó".split()

V, N = f"[{VOWELS}]", f"[^{VOWELS}]"
STEP1_ALL = (
    STEP1_DELETE + STEP1_LOG + STEP1_U + STEP1_ENTE + STEP1_AMENTE
    + STEP1_MENTE + STEP1_IDADE + STEP1_IVO + STEP1_IRA
)
# Words a worker remembers between batches.
CACHED_WORDS = 200_000


def _ending(suffixes: list[str]) -> re.Pattern:
    # Searching from the left for an alternative anchored at the end finds the longest suffix.
    return re.compile("(?:" + "|".join(suffixes) + ")$")


# What lies before a region; the region is the remainder.
_BEFORE_R1 = re.compile(f"{N}*{V}+{N}")
_BEFORE_RV = re.compile(f".{N}+{V}|{V}{V}+{N}|{N}{V}.")
_STEP1 = _ending(STEP1_ALL)
_STEP2 = _ending(STEP2_DELETE)
_STEP4 = _ending(STEP4_DELETE)
_FOLLOW_UPS = {
    **{s: re.compile(AFTER_AMENTE) for s in STEP1_AMENTE},
    **{s: re.compile(AFTER_MENTE) for s in STEP1_MENTE},
    **{s: re.compile(AFTER_IDADE) for s in STEP1_IDADE},
    **{s: re.compile(AFTER_IVO) for s in STEP1_IVO},
}
_REPLACEMENTS = {
    **dict.fromkeys(STEP1_LOG, "log"), **dict.fromkeys(STEP1_U, "u"),
    **dict.fromkeys(STEP1_ENTE, "ente"), **dict.fromkeys(STEP1_IRA, "ir"),
}


def _region(pattern: re.Pattern, word: str, start: int = 0) -> int:
    found = pattern.match(word, start)
    return found.end() if found else len(word)


def _drop(pattern: re.Pattern, word: str, start: int) -> str:
    """Delete a suffix that lies wholly behind ``start``."""
    return word[:start] + pattern.sub("", word[start:]) if start < len(word) else word


def _standard_suffix(word: str, r1: int, r2: int, rv: int) -> str:
    found = _STEP1.search(word)
    if not found:
        return word
    suffix, at = found.group(), found.start()
    base = word[:at]
    if suffix in STEP1_IRA:
        allowed = at >= rv and base.endswith("e")
    else:
        allowed = at >= (r1 if suffix in STEP1_AMENTE else r2)
    if not allowed:
        return word
    if suffix in _FOLLOW_UPS:
        return _drop(_FOLLOW_UPS[suffix], base, r2)
    return base + _REPLACEMENTS.get(suffix, "")


@lru_cache(maxsize=CACHED_WORDS)
def stem(word: str) -> str:
    """Stem one lower-case word."""
    before = word.replace("ã", "a~").replace("õ", "o~")
    r1 = _region(_BEFORE_R1, before)
    r2 = _region(_BEFORE_R1, before, r1)
    rv = _region(_BEFORE_RV, before)
    now = _standard_suffix(before, r1, r2, rv)
    if now == before:
        now = _drop(_STEP2, before, rv)
    if now == before:
        now = _drop(_STEP4, before, rv)
    elif now.endswith("ci") and len(now) > rv:
        now = now[:-1]
    if now[-1:] in ("e", "é", "ê") and len(now) > rv:
        hard = now[-3:-1] in ("gu", "ci") and len(now) - 1 > rv
        now = now[:-2] if hard else now[:-1]
    elif now.endswith("ç"):
        now = now[:-1] + "c"
    return now.replace("a~", "ã").replace("o~", "õ")


def _stem_distinct(words: pa.Array) -> pa.Array:
    coded = words.dictionary_encode()
    return pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


@F.arrow_udf(T.StringType())
def stem_word(words: pa.Array) -> pa.Array:
    """Stem a column of lower-case words."""
    return _stem_distinct(words)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_words(arrays: pa.Array) -> pa.Array:
    """Stem every word of a column of word arrays; order and length are kept."""
    sizes = pc.fill_null(pc.list_value_length(arrays), 0)
    ends = pc.cumulative_sum(sizes.cast(pa.int32()))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, _stem_distinct(arrays.flatten()), mask=arrays.is_null())
