"""Lexicon scores: word valences summed per text, plain or with the published context rules.

The rules (Hutto and Gilbert 2014) look at the three words before a sentiment word and at the two
after it. Each word row therefore refers to the words of its own document. An inner join with the
lexicon leaves the sentiment words alone, before any rule, neighbour or further lookup, and one base
row per text, which comes from a pseudo-word at the end of every text. What follows is one sum per
text: no window over word rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinaria.functions.labels import label_from_compound
from opinaria.functions.text import WHITESPACE
from opinaria.operators.dimension import MAX_BROADCAST_ROWS, lookup_join

# The published constants and word lists of the context rules.
NORMALISER = 15.0
COMPOUND_DIGITS = 4
BOOST = 0.293
DAMPEN = -0.293
CAPITALS = 0.733
NEGATION = -0.74
NEVER_SO = 1.25
BEFORE_BUT = 0.5
AFTER_BUT = 1.5
SECOND_WORD = 0.95
THIRD_WORD = 0.9
EXCLAMATION = 0.292
MAX_EXCLAMATIONS = 4
QUESTION = 0.18
MANY_QUESTIONS = 0.96
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SHORT_WORD = 2
BOOSTERS = (
    "absolutely amazingly awfully completely considerable considerably decidedly deeply effing "
    "enormous enormously entirely especially exceptional exceptionally extreme extremely "
    "fabulously flipping flippin frackin fracking fricking frickin frigging friggin fully fuckin "
    "fucking fuggin fugging greatly hella highly hugely incredible incredibly intensely major "
    "majorly more most particularly purely quite really remarkably so substantially thoroughly "
    "total totally tremendous tremendously uber unbelievably unusually utter utterly very"
).split()
DAMPENERS = (
    "almost barely hardly kinda kindof kind-of less little marginal marginally occasional "
    "occasionally partly scarce scarcely slight slightly somewhat sorta sortof sort-of"
).split()
DAMPENER_PAIRS = ("just enough", "kind of", "sort of")
NEGATIONS = (
    "aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't "
    "didn't doesn't dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't "
    "haven't isn't mightn't mustn't neednt needn't never none nope nor not nothing nowhere "
    "oughtnt shant shouldnt uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't "
    "without wont wouldnt won't wouldn't rarely seldom despite"
).split()
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0,
    "yeah right": -2.0, "kiss of death": -1.5, "to die for": 3.0, "beating heart": 3.1,
    "broken heart": -2.9,
}
# Of each idiom and pair of dampeners the rarest word: without one of them there is no such phrase.
PHRASE_WORDS = tuple("shit bomb ass badass stop right kiss die beating broken enough kind sort".split())

# No word is empty, so this one marks the base row of a text.
BASE_WORD = ""

_MARK = "[" + re.escape(PUNCTUATION) + "]"
_INNER = "(?!" + _MARK + ")[^ ]"
# White space that is not one plain space between words: most texts have little of it to replace.
UNEVEN_WHITESPACE = f"[{WHITESPACE}&&[^ ]]{WHITESPACE}*+| {WHITESPACE}++"
# A word of capitals: an upper-case letter, and no letter of lower or title case. The parts cannot
# give characters back, so a long word is read once.
_SMALL = r"\p{Ll}\p{Lt}ªº\s\x1c-\x1f\x85\p{Z}"
CAPITAL_WORD = rf"[^{_SMALL}\p{{Lu}}]*+\p{{Lu}}[^{_SMALL}]*+"
# The following are looked for in words with one space before each and one at the end.
# A word with punctuation at its start or end; it matches only where three characters or more are inside.
PUNCTUATED = f" (?={_MARK}|[^ ]*+(?<={_MARK}) ){_MARK}*+({_INNER}[^ ]{{{SHORT_WORD - 1},}}{_INNER}){_MARK}*(?= )"
A_CAPITAL_WORD = f" {CAPITAL_WORD} "
OTHER_WORD = r"[\p{Ll}\p{Lt}ªº]| [^\p{Lu} ]+ "
BUT = f" {_MARK}*but{_MARK}* "


def _one_line(text: Column) -> Column:
    """The words of a text as they are, one space apart."""
    return F.trim(F.regexp_replace(text, UNEVEN_WHITESPACE, " "))


def _pieces(line: Column) -> Column:
    """The words of a line; none for a text that is empty or null."""
    return F.when(F.coalesce(line, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def _bare_line(line: Column) -> Column:
    """The words in their own case, outer punctuation taken off unless two characters or fewer are left."""
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), line, F.lit(" ")), PUNCTUATED, " $1"))


def _mixed(line: Column) -> Column:
    """Whether some words, but not all, are in capitals."""
    spaced = F.concat(F.lit(" "), line, F.lit(" "))
    return spaced.rlike(A_CAPITAL_WORD) & spaced.rlike(OTHER_WORD)


def _place_of_but(line: Column) -> Column:
    """The place, from 1, of the first 'but'; null without one."""
    lowered = F.lower(line)
    parts = F.split(F.concat(F.lit(" "), lowered, F.lit(" ")), BUT, 2)
    place = _count(parts[0], " ") + 1
    return F.when(lowered.contains("but") & (F.size(parts) == 2), place)


def compound_score(total: Column) -> Column:
    """A valence sum on the scale -1 to 1, rounded before any threshold is applied."""
    return F.round(total / F.sqrt(total * total + NORMALISER), COMPOUND_DIGITS)


def _lexicon_size(lexicon: DataFrame) -> int:
    return lexicon.limit(MAX_BROADCAST_ROWS + 1).count()


def _hits(rows: DataFrame, lexicon: DataFrame, size: int) -> DataFrame:
    """Rows of sentiment words with their valence, and the base rows with none."""
    base = lexicon.sparkSession.range(1).select(
        F.lit(BASE_WORD).alias("term"), F.lit(None).cast(lexicon.schema["valence"].dataType).alias("valence")
    )
    # An empty term becomes null, which meets no word; a filter would be inferred for every word row too.
    known = lexicon.select(F.nullif("term", F.lit(BASE_WORD)).alias("term"), "valence").unionAll(base)
    return lookup_join(rows, known, ["term"], known_rows=size + 1)


def _words_and_base(words: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, at, word): a row per word and the base row, places from 1.

    The outer form of explode keeps the optimizer from putting a size filter in front, which would
    split every text again; no word is null.
    """
    rows = words.select(*keep, F.posexplode_outer(F.concat("words", F.array(F.lit(BASE_WORD)))).alias("at", "word"))
    return rows.select(*keep, (F.col("at") + 1).alias("at"), F.coalesce("word", F.lit(BASE_WORD)).alias("word"))


def plain_scores(
    texts: DataFrame, lexicon: DataFrame, key: str = "id", text: str = "texto"
) -> DataFrame:
    """(key, compound) from the sum of the valences of the words found; 0 where none is.

    ``lexicon`` is (term, valence) with lower-case terms, each once.
    """
    words = texts.select(key, _pieces(F.lower(_bare_line(_one_line(F.col(text))))).alias("words"))
    rows = _words_and_base(words, key).select(key, F.col("word").alias("term"))
    found = _hits(rows, lexicon, _lexicon_size(lexicon))
    sums = found.groupBy(key).agg(F.sum(F.coalesce("valence", F.lit(0.0))).alias("total"))
    return sums.select(key, compound_score(F.col("total")).alias("compound"))


def emoji_as_words(text: Column, descriptions: Mapping[str, str]) -> Column:
    """Write each known emoji as its description, set off by a space from what is before it."""
    if not descriptions:
        return text
    known = F.create_map(*[F.lit(x) for pair in descriptions.items() for x in pair])
    symbols = F.array_distinct(
        F.regexp_extract_all(text, F.lit(r"[^\x00-\x7f\p{L}\p{N}\p{Z}]"), F.lit(0))
    )

    def write(done: Column, symbol: Column) -> Column:
        said = F.element_at(known, symbol)
        # A space goes in front unless there is one already or the text begins here.
        apart = F.replace(done, symbol, F.concat(F.lit(" "), symbol))
        apart = F.replace(apart, F.concat(F.lit("  "), symbol), F.concat(F.lit(" "), symbol))
        apart = F.when(done.startswith(symbol), apart.substr(F.lit(2), F.length(apart))).otherwise(apart)
        return F.when(said.isNull(), done).otherwise(F.replace(apart, symbol, said))

    return F.aggregate(symbols, text, write)


def _is_capitals(word: Column) -> Column:
    """Most words are ASCII in lower case, which needs no pattern."""
    plain = (F.length(word) == F.octet_length(word)) & (F.lower(word) == word)
    return ~plain & word.rlike(f"^{CAPITAL_WORD}$")


def _word_rows(texts: DataFrame, key: str, text: str, descriptions: Mapping[str, str]) -> DataFrame:
    """One row per word with all words and the marks of its text, and the base row of each text.

    Every row refers to the words of its text, which are copied only where a row is kept: take what is
    needed of them right after the join with the lexicon.
    """
    said = texts.select(key, emoji_as_words(F.col(text), descriptions).alias("said"))
    lines = said.select(key, _emphasis(F.col("said")).alias("emphasis"), _one_line(F.col("said")).alias("line"))
    words = lines.select(
        key, "emphasis", _mixed(F.col("line")).alias("mixed"), _place_of_but(F.col("line")).alias("but"),
        _pieces(_bare_line(F.col("line"))).alias("words"),
    )
    rows = _words_and_base(words, key, "emphasis", "mixed", "but", "words")
    return rows.withColumn("term", F.lower("word"))


def _with_near_words(rows: DataFrame, key: str) -> DataFrame:
    """Sentiment words with the words before (p) and behind (n) them, and what the rules ask of each.

    For base rows all of it is null, which ends each lookup and each rule at once. The test for phrases
    keeps the rules here out of the generated code of the joins around them, as the fold below does.
    """
    marks = (key, "emphasis", "mixed", "but", "at", "term", "valence")
    found = F.col("valence").isNotNull()

    def near(offset: int) -> Column:
        return F.get("words", F.when(found, F.col("at") - 1 + offset))

    rows = rows.select(*marks, "word", *[near(-s).alias(f"w{s}") for s in (1, 2, 3)],
                       *[near(s).alias(f"a{s}") for s in (1, 2)])
    loud_near = found & F.col("mixed")
    rows = rows.select(
        *marks, F.when(loud_near, _is_capitals(F.col("word"))).alias("caps"),
        *[F.lower(f"w{s}").alias(f"p{s}") for s in (1, 2, 3)],
        *[F.when(loud_near, _is_capitals(F.col(f"w{s}"))).alias(f"caps{s}") for s in (1, 2, 3)],
        *[F.lower(f"a{s}").alias(f"n{s}") for s in (1, 2)],
    )
    around = F.array("p3", "p2", "p1", "term", "n1", "n2")
    phrase = F.coalesce(F.exists(around, lambda w: w.isin(*PHRASE_WORDS)), F.lit(False))
    return rows.select(
        *rows.columns, F.when(found, phrase).alias("phrase"),
        *[F.when(found, rule(F.col(f"p{s}"))).alias(f"{name}{s}")
          for s in (1, 2, 3) for name, rule in (("direction", _direction), ("negates", _is_negation))],
    )


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def _emphasis(text: Column) -> Column:
    marks = F.least(_count(text, "!"), F.lit(MAX_EXCLAMATIONS)) * EXCLAMATION
    asked = _count(text, "?")
    questions = (
        F.when(asked > 3, F.lit(MANY_QUESTIONS)).when(asked > 1, asked * QUESTION).otherwise(F.lit(0.0))
    )
    return marks + questions


def _direction(word: Column) -> Column:
    """1 for a booster, -1 for a dampener, 0 for any other word."""
    return F.when(word.isin(BOOSTERS), F.lit(1)).when(word.isin(DAMPENERS), F.lit(-1)).otherwise(F.lit(0))


def _is_negation(word: Column) -> Column:
    return F.coalesce(word.isin(NEGATIONS) | word.contains("n't"), F.lit(False))


def _boost(direction: Column, capitals: Column, valence: Column) -> Column:
    """What a booster or dampener adds, in the direction of the valence."""
    sign = F.when(valence < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    loud = F.when(capitals & F.col("mixed"), F.when(valence > 0, CAPITALS).otherwise(-CAPITALS)).otherwise(0.0)
    return F.when(direction == 0, F.lit(0.0)).otherwise(sign * BOOST * direction + loud)


def _negated(step: Column, negates: Column, valence: Column) -> Column:
    p1, p2, p3 = F.col("p1"), F.col("p2"), F.col("p3")
    plain = F.when(negates, valence * NEGATION).otherwise(valence)
    second = (
        F.when((p2 == "never") & p1.isin("so", "this"), valence * NEVER_SO)
        .when((p2 == "without") & (p1 == "doubt"), valence)
        .otherwise(plain)
    )
    third = (
        F.when(((p3 == "never") & p2.isin("so", "this")) | p1.isin("so", "this"), valence * NEVER_SO)
        .when((p3 == "without") & ((p2 == "doubt") | (p1 == "doubt")), valence)
        .otherwise(plain)
    )
    last = F.when(F.col("phrase"), _idiomatic(third)).otherwise(third)
    return F.when(step == 1, plain).when(step == 2, second).otherwise(last)


def _with_neighbours(valence: Column, known) -> Column:
    """Fold the three words before a sentiment word into its valence, nearest first.

    Most sentiment words have no modifier near them and skip the fold. It also keeps these rules out
    of the generated code of the joins around them, which would otherwise grow past the size the JVM
    still compiles.
    """
    before = F.array(*[
        F.struct(
            F.lit(step).alias("step"), F.lit(fade).alias("fade"),
            (F.col(f"p{step}").isNull() | known(f"p{step}")).alias("skipped"),
            *[F.col(f"{name}{step}").alias(name) for name in ("caps", "direction", "negates")],
        )
        for step, fade in ((1, 1.0), (2, SECOND_WORD), (3, THIRD_WORD))
    ])

    def apply(value: Column, near: Column) -> Column:
        boosted = value + near["fade"] * _boost(near["direction"], near["caps"], value)
        return F.when(near["skipped"], value).otherwise(_negated(near["step"], near["negates"], boosted))

    modified = F.col("phrase") | F.coalesce(F.col("p1").isin("so", "this"), F.lit(False))
    for step in (1, 2, 3):
        modified = modified | (F.col(f"direction{step}") != 0) | F.col(f"negates{step}")
    return F.when(valence.isNotNull() & modified, F.aggregate(before, valence, apply)).otherwise(valence)


def _idiom(*words: Column) -> Column:
    known = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in IDIOMS.items())), F.lit(","), F.lit(":"))
    return F.try_element_at(known, F.concat_ws(" ", *words)).cast("double")


def _idiomatic(valence: Column) -> Column:
    """Idioms around the word replace its valence; a later, forward match wins."""
    w, p1, p2, p3, n1, n2 = (F.col(c) for c in ("term", "p1", "p2", "p3", "n1", "n2"))
    behind = F.coalesce(
        _idiom(p1, w), _idiom(p2, p1, w), _idiom(p2, p1), _idiom(p3, p2, p1), _idiom(p3, p2)
    )
    ahead = F.coalesce(F.when(n2.isNotNull(), _idiom(w, n1, n2)), F.when(n1.isNotNull(), _idiom(w, n1)))
    dampened = sum(
        F.when(F.concat_ws(" ", *pair).isin(*DAMPENER_PAIRS), DAMPEN).otherwise(0.0)
        for pair in ((p3, p2), (p2, p1))
    )
    return F.coalesce(ahead, behind, valence) + dampened


def context_scores(
    texts: DataFrame, lexicon: DataFrame, key: str = "id", text: str = "texto",
    emoji_descriptions: Mapping[str, str] | None = None,
) -> DataFrame:
    """(key, compound) with boosters, negation, capitals, idioms, 'but' and punctuation.

    Every text keeps a row: without sentiment words its compound is 0.
    """
    size = _lexicon_size(lexicon)
    rows = _word_rows(texts, key, text, emoji_descriptions or {})
    rows = _with_near_words(_hits(rows, lexicon, size), key)
    for near in ("p1", "p2", "p3", "n1"):
        flags = lexicon.select(F.col("term").alias(near), F.lit(True).alias(f"{near}_known"))
        rows = lookup_join(rows, flags, [near], "left", known_rows=size)

    def known(near: str) -> Column:
        return F.coalesce(F.col(f"{near}_known"), F.lit(False))

    term, p1, p2, p3, v = (F.col(c) for c in ("term", "p1", "p2", "p3", "v"))
    modifier = (_direction(term) != 0) | ((term == "kind") & (F.col("n1") == "of"))
    after_no = (p1 == "no") | (p2 == "no") | ((p3 == "no") & p1.isin("or", "nor"))
    rows = rows.withColumn(
        "v",
        F.when(F.col("valence").isNull() | modifier, F.lit(None))
        .when(after_no, F.col("valence") * NEGATION)
        .when((term == "no") & known("n1"), F.lit(0.0))
        .otherwise(F.col("valence")),
    )
    loud = F.col("caps") & F.col("mixed")
    rows = rows.withColumn(
        "v", F.when(loud, v + F.when(v > 0, CAPITALS).otherwise(-CAPITALS)).otherwise(v)
    )
    rows = rows.withColumn("v", _with_neighbours(v, known))
    least = (p1 == "least") & ~known("p1") & (p2.isNull() | ~p2.isin("at", "very"))
    rows = rows.withColumn("v", F.when(least, v * NEGATION).otherwise(v))
    place, but = F.col("at"), F.col("but")
    rows = rows.withColumn(
        "v",
        F.when((but > 0) & (place < but), v * BEFORE_BUT)
        .when((but > 0) & (place > but), v * AFTER_BUT)
        .otherwise(v),
    )
    sums = rows.groupBy(key).agg(
        F.sum(F.coalesce(v, F.lit(0.0))).alias("total"), F.max("emphasis").alias("emphasis")
    )
    total = F.col("total")
    emphatic = (
        F.when(total > 0, total + F.col("emphasis"))
        .when(total < 0, total - F.col("emphasis"))
        .otherwise(total)
    )
    return sums.select(key, compound_score(emphatic).alias("compound"))


def lexicon_labels(scores: DataFrame, column: str = "sent_vader", key: str = "id") -> DataFrame:
    """(key, label) from compound scores."""
    return scores.select(key, label_from_compound(F.col("compound")).alias(column))


def with_lexicon_label(
    texts: DataFrame, lexicon: DataFrame, column: str = "sent_vader", text: str = "texto",
    key: str = "id", *, context: bool = True, to: DataFrame | None = None,
) -> DataFrame:
    """Add a lexicon label to every row, or to the rows of ``to`` that have the same keys.

    Word rows carry the key alone, never the text. The scores come out hashed on the key, so the
    join moves only the texts, and not even those when they already lie hashed or bucketed on it.
    """
    score = context_scores if context else plain_scores
    labels = lexicon_labels(score(texts.select(key, text), lexicon, key, text), column, key)
    return (texts if to is None else to).join(labels, key, "left")
