"""The registered queries in DuckDB SQL, for checking values on the same Parquet tables."""

from __future__ import annotations

from opinaria.functions import stemming as st
from opinaria.functions.stop_words import stop_words
from opinaria.operators import external, lexicon

WS = r"[\s\v\x1c-\x1f\x85\p{Z}]"
NOT_WS = r"[^\s\v\x1c-\x1f\x85\p{Z}]"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(quoted(v) for v in values)


def replaced(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(by)}, 'g')"


def tags(text: str, by: str = "") -> str:
    return replaced(text, "<.*?>", by)


def cleaned(text: str) -> str:
    spaced = replaced(tags(text, " "), f"https?://{NOT_WS}+", " ")
    return f"coalesce(trim({replaced(spaced, WS + '+', ' ')}), '')"


def words(text: str) -> str:
    plain = f"lower({replaced(tags(text), '[^\\p{L}\\p{N}]', ' ')})"
    cut = f"list_filter(string_split({plain}, ' '), lambda x: x <> '')"
    pairs = (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na"))
    cases = " ".join(f"WHEN '{a}{b}' THEN ['{a}', '{b}']" for a, b in pairs)
    return f"flatten(list_transform({cut}, lambda x: CASE x {cases} ELSE [x] END))"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


# ---- inputs -------------------------------------------------------------------------------------

DOC_WORDS = f"doc_words AS (SELECT doc_id, lang, {words('text')} AS w FROM documents)"
DOC_TERMS = """doc_terms AS (
    SELECT doc_id, term FROM (SELECT doc_id, unnest(w) AS term FROM doc_words) WHERE length(term) >= 2)"""
DOC_VOCAB = """doc_freq AS (SELECT term, count(*) AS n FROM doc_terms GROUP BY term),
vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_idx
    FROM (SELECT term FROM doc_freq ORDER BY n DESC, term LIMIT 1000))"""
STOP = "stop AS (" + " UNION ALL ".join(
    f"SELECT '{code}' AS lang, unnest([{listed(sorted(set(stop_words(code))))}]) AS term"
    for code in ("de", "en", "es", "fr")
) + ")"
REVIEW_WORDS = DOC_WORDS + """, review_words AS (
    SELECT d.doc_id AS id, CASE WHEN l.quality = 1 THEN 'pos' ELSE 'neg' END AS label, d.w
    FROM doc_words d JOIN labels l ON d.doc_id = l.doc_id)"""
TITLES = "titles AS (SELECT conv_id AS post_id, text AS title FROM conversations WHERE turn = 0)"
COMMENTS = """comments AS (
    SELECT conv_id AS post_id, turn AS pos, text AS body FROM conversations WHERE turn > 0),
first_comments AS (SELECT post_id, pos, body FROM comments
    QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY pos) <= 5)"""
FOUND = TITLES + """, found AS (
    SELECT * FROM titles WHERE contains(lower(title), 'the') ORDER BY post_id LIMIT 8)"""


def texts_from(posts: str) -> str:
    return f"""post_texts AS (SELECT * FROM (
    SELECT post_id, 0::BIGINT AS pos, 'titulo' AS origem, {cleaned('title')} AS texto FROM {posts}
        WHERE title <> ''
    UNION ALL
    SELECT c.post_id, c.pos, 'comentario', {cleaned('c.body')} FROM first_comments c
        WHERE c.post_id IN (SELECT post_id FROM {posts})) WHERE texto <> '')"""


ALL_POSTS = TITLES + ", " + COMMENTS + ", " + texts_from("titles")
FOUND_POSTS = FOUND + ", " + COMMENTS + ", " + texts_from("found")
TURNS = f"""turns AS (SELECT * FROM (SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS id,
    CASE WHEN turn = 0 THEN 'titulo' ELSE 'comentario' END AS origem, {cleaned('text')} AS texto
    FROM conversations) WHERE texto <> '')"""


# A turn answers one of the three before it; the newest of several answers comes first.
FOREST = """replies AS (SELECT conv_id AS post_id, turn AS comment_id, -turn AS pos, text AS body,
    CASE WHEN turn - 1 - turn % 3 > 0 THEN turn - 1 - turn % 3 END AS parent_id FROM conversations WHERE turn > 0),
forest AS (SELECT post_id, comment_id, body, 1 AS depth, [pos] AS path FROM replies WHERE parent_id IS NULL
    UNION ALL SELECT r.post_id, r.comment_id, r.body, f.depth + 1, list_append(f.path, r.pos)
    FROM replies r JOIN forest f ON r.post_id = f.post_id AND r.parent_id = f.comment_id)"""
FOREST_FIRST = """, first_comments AS (SELECT * FROM (SELECT post_id, body,
    row_number() OVER (PARTITION BY post_id ORDER BY depth, path) AS pos FROM forest) WHERE pos <= 5)"""
RANKED = f"""title_words AS (SELECT post_id, {words('title')} AS w FROM titles),
title_terms AS (SELECT post_id, len(w) AS length, unnest(w) AS term FROM title_words),
postings AS (SELECT post_id, length, term, count(*) AS f FROM title_terms GROUP BY ALL),
sizes AS (SELECT count(*) AS n, avg(len(w))::DOUBLE AS mean FROM title_words WHERE len(w) > 0),
spread AS (SELECT term, count(*) AS n FROM postings GROUP BY term),
asked AS (SELECT * FROM (VALUES ('the', 'the'), ('of and ing', 'of'), ('of and ing', 'and'), ('of and ing', 'ing'),
    ('Que la', 'que'), ('Que la', 'la'), ('der und', 'der'), ('der und', 'und')) AS x(keyword, term)),
bm25 AS (SELECT a.keyword, p.post_id, round(sum(ln(1 + (z.n - s.n + 0.5::DOUBLE) / (s.n + 0.5::DOUBLE)) * p.f * 2.2::DOUBLE
        / (p.f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.length / z.mean))), 6) AS score
    FROM asked a JOIN postings p ON p.term = a.term JOIN spread s ON s.term = a.term CROSS JOIN sizes z GROUP BY ALL),
ranked AS (SELECT keyword, row_number() OVER (PARTITION BY keyword ORDER BY score DESC, post_id) AS rank, post_id, score
    FROM bm25 QUALIFY rank <= 8)"""


def responses(ids: str) -> str:
    return f"""responses AS (SELECT id, CASE
        WHEN d IN ('0', '1', '2', '3') THEN 'positivo' WHEN d IN ('4', '5') THEN ' Positivo.'
        WHEN d IN ('6', '7', '8') THEN 'negativo' WHEN d = '9' THEN 'NEGATIVO' || chr(10)
        WHEN d = 'a' THEN 'neutra' WHEN d = 'b' THEN 'Neither' WHEN d = 'c' THEN '' END AS answer,
        d = 'e' AS error
    FROM (SELECT id, substr(md5(id::VARCHAR), 1, 1) AS d FROM {ids}) WHERE d <> 'f')"""


def lenient(answer: str) -> str:
    a = f"lower({answer})"
    return f"""CASE WHEN contains({a}, 'positivo') THEN 'positivo' WHEN contains({a}, 'negativo')
        THEN 'negativo' WHEN contains({a}, 'neutro') OR contains({a}, 'neutra')
        OR contains({a}, 'neither') THEN 'neutro' ELSE 'nao_classificado' END"""


def strict(answer: str, error: str) -> str:
    a = f"lower({replaced(answer, f'^{WS}+|{WS}+$', '')})"
    return f"""CASE WHEN coalesce({error}, false) OR {answer} IS NULL THEN 'erro'
        WHEN {a} IN ('positivo', 'negativo') THEN {a} ELSE 'nao_classificado' END"""


LABELLED_TURNS = TURNS + ", " + responses("turns") + f""", labelled AS (
    SELECT t.id, t.origem, t.texto,
        {lenient('CASE WHEN NOT coalesce(r.error, false) THEN r.answer END')} AS sent_gemini
    FROM turns t LEFT JOIN responses r ON t.id = r.id)"""
MARKED = """marked AS (SELECT doc_id AS id,
    CASE WHEN quality = 1 THEN 'positivo' ELSE 'negativo' END AS sentiment FROM labels)"""
ANSWERED = MARKED + ", " + responses("marked") + f""", answered AS (
    SELECT m.id, m.sentiment, {strict('r.answer', 'r.error')} AS prediction
    FROM marked m LEFT JOIN responses r ON m.id = r.id)"""


KEPT = "kept AS (SELECT * FROM answered WHERE prediction IN ('positivo', 'negativo'))"


def scorer(text: str) -> str:
    return f"""CASE WHEN contains({text}, '?') THEN 'nao_classificado'
        WHEN contains({text}, 'the') THEN 'positivo' WHEN contains({text}, ' and ') THEN 'negativo'
        ELSE 'neutro' END"""


# ---- Naive Bayes --------------------------------------------------------------------------------

IS_TEST = "substr(md5('9:' || id::VARCHAR), 1, 8) < '33333333'"


def bayes(source: str = "review_words", vocabulary_of: str | None = None, p: str = "") -> str:
    """CTEs of one experiment over (id, label, w); names take the prefix ``p``."""
    vocabulary_of = vocabulary_of or f"{p}terms"
    return f"""{p}terms AS (SELECT * FROM (SELECT id, label, unnest(w) AS term FROM {source})
        WHERE length(term) >= 2),
    {p}train AS (SELECT id, label FROM {source} WHERE NOT {IS_TEST}),
    {p}train_terms AS (SELECT * FROM {p}terms WHERE NOT {IS_TEST}),
    {p}vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_idx FROM (SELECT term
        FROM {vocabulary_of} GROUP BY term ORDER BY count(*) DESC, term LIMIT 1000)),
    {p}priors AS (SELECT label, count(*) AS n,
        ln(count(*)::DOUBLE / (SELECT count(*) FROM {p}train)) AS log_prior
        FROM {p}train GROUP BY label),
    {p}counts AS (SELECT p.label, v.term, p.n AS n_c, p.log_prior,
            coalesce(c.tf, 0) AS tf, coalesce(c.df, 0) AS df
        FROM {p}priors p CROSS JOIN {p}vocab v
        LEFT JOIN (SELECT label, term, count(*) AS tf, count(DISTINCT id) AS df
            FROM {p}train_terms GROUP BY label, term) c ON c.label = p.label AND c.term = v.term),
    {p}mnb AS (SELECT label, term, ln((tf + 1.0::DOUBLE) / (sum(tf) OVER (PARTITION BY label)
            + 1.0::DOUBLE * count(*) OVER (PARTITION BY label))) AS weight FROM {p}counts
        UNION ALL SELECT label, '', log_prior FROM {p}priors),
    {p}odds AS (SELECT label, term, log_prior, (df + 1.0::DOUBLE) / (n_c + 2.0::DOUBLE) AS q
        FROM {p}counts),
    {p}bnb AS (SELECT label, term, ln(q) - ln(1 - q) AS weight FROM {p}odds
        UNION ALL SELECT label, '', max(log_prior) + sum(ln(1 - q)) FROM {p}odds GROUP BY label)"""


def scored(kind: str, source: str = "review_words", p: str = "", name: str | None = None) -> str:
    """CTE of (id, label, score) of every text of ``source`` for every class."""
    once = "DISTINCT" if kind == "bnb" else ""
    return f"""{name or p + kind + '_scores'} AS (SELECT t.id, w.label, round(sum(w.weight), 6) AS score
        FROM (SELECT {once} id, unnest(list_concat([''], w)) AS term FROM {source}) t
        JOIN {p}{kind} w ON t.term = w.term GROUP BY t.id, w.label)"""


def best(scores: str) -> str:
    return f"(SELECT id, label AS prediction FROM {scores} QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, label) = 1)"


def predictions(source: str, p: str = "") -> str:
    parts = [
        f"""SELECT '{model}' AS model, s.id, s.label, b.prediction
        FROM {source} s JOIN {best(p + kind + '_scores')} b ON s.id = b.id WHERE {IS_TEST.replace('id::', 's.id::')}"""
        for model, kind in (("multinomial", "mnb"), ("bernoulli", "bnb"))
    ]
    return "predictions AS (" + " UNION ALL ".join(parts) + ")"


# Absent terms have count 0: their share of the score is the class constant ``c``.
GAUSSIAN = """gnb_n AS (SELECT id, label, term, count(*) AS n FROM terms
        WHERE term IN (SELECT term FROM vocab) GROUP BY id, label, term),
    gnb_train AS (SELECT g.* FROM gnb_n g WHERE g.id IN (SELECT id FROM train)),
    gnb_eps AS (SELECT 1e-9::DOUBLE * max(v) AS e FROM (SELECT sum(n * n)::DOUBLE / (SELECT count(*) FROM train)
        - (sum(n)::DOUBLE / (SELECT count(*) FROM train)) ** 2 AS v FROM gnb_train GROUP BY term)),
    gnb AS (SELECT label, term, log_prior, m, q - m * m + (SELECT e FROM gnb_eps) AS s2 FROM (
        SELECT p.label, v.term, p.log_prior, coalesce(t.s, 0)::DOUBLE / p.n AS m, coalesce(t.ss, 0)::DOUBLE / p.n AS q
        FROM priors p CROSS JOIN vocab v LEFT JOIN (SELECT label, term, sum(n) AS s, sum(n * n) AS ss
            FROM gnb_train GROUP BY label, term) t ON t.label = p.label AND t.term = v.term)),
    gnb_base AS (SELECT label, max(log_prior) - sum(0.5::DOUBLE * ln(2 * pi() * s2) + m * m / (2 * s2)) AS c
        FROM gnb GROUP BY label),
    gnb_scores AS (SELECT r.id, b.label, b.c + coalesce(sum((2 * g.n * w.m - g.n * g.n) / (2 * w.s2)), 0) AS score
        FROM review_words r CROSS JOIN gnb_base b LEFT JOIN gnb_n g ON g.id = r.id
        LEFT JOIN gnb w ON w.label = b.label AND w.term = g.term GROUP BY r.id, b.label, b.c)"""

PLAIN_BAYES = REVIEW_WORDS + ", " + bayes()
PLAIN_SCORES = PLAIN_BAYES + ", " + scored("mnb") + ", " + scored("bnb")
TRAIN_VOCAB_SCORES = (
    REVIEW_WORDS + ", " + bayes(vocabulary_of="train_terms") + ", " + scored("mnb") + ", " + scored("bnb")
)

# ---- stemmer ------------------------------------------------------------------------------------


def region(word: str, head: str) -> str:
    """Start of a region: length of the head, or of the word where there is none."""
    return f"coalesce(nullif(length(regexp_extract({word}, {quoted(head)})), 0), length({word}))"


def stems(source: str) -> str:
    """CTEs that end in stems(term, stem) for the distinct terms of ``source``."""
    v, n = st.V, st.N

    def any_of(*groups):
        flat = [s for g in groups for s in g]
        return "(?:" + "|".join(sorted(flat, key=len, reverse=True)) + ")$"

    def tail(word, start, pattern):
        return f"(left({word}, {start}) || regexp_replace(substr({word}, {start} + 1), {quoted(pattern)}, ''))"

    step1 = any_of(st.STEP1_ALL)
    return f"""s0 AS (SELECT term, replace(replace(term, 'ã', 'a~'), 'õ', 'o~') AS w FROM {source}),
    s1 AS (SELECT *, {region('w', f'^{n}*{v}+{n}')} AS r1,
        {region('w', f'^{n}*{v}+{n}{n}*{v}+{n}')} AS r2,
        {region('w', f'^(?:.{n}+{v}|{v}{v}+{n}|{n}{v}.)')} AS rv,
        regexp_extract(w, {quoted(step1)}) AS x FROM s0),
    s2 AS (SELECT *, left(w, length(w) - length(x)) AS b, length(w) - length(x) AS cut_at FROM s1),
    s3 AS (SELECT term, w, rv, CASE WHEN x = '' THEN w
        WHEN x = 'amente' THEN CASE WHEN cut_at >= r1 THEN {tail('b', 'r2', '(?:ativ|iv|os|ic|ad)$')} ELSE w END
        WHEN x IN ('ira', 'iras') THEN CASE WHEN cut_at >= rv AND b LIKE '%e' THEN b || 'ir' ELSE w END
        WHEN cut_at < r2 THEN w
        WHEN x IN ({listed(st.STEP1_LOG)}) THEN b || 'log'
        WHEN x IN ({listed(st.STEP1_U)}) THEN b || 'u'
        WHEN x IN ({listed(st.STEP1_ENTE)}) THEN b || 'ente'
        WHEN x = 'mente' THEN {tail('b', 'r2', '(?:ante|avel|ível)$')}
        WHEN x IN ('idade', 'idades') THEN {tail('b', 'r2', '(?:abil|ic|iv)$')}
        WHEN x IN ({listed(st.STEP1_IVO)}) THEN {tail('b', 'r2', 'at$')}
        ELSE b END AS u FROM s2),
    s4 AS (SELECT term, w, rv, CASE WHEN u = w THEN {tail('u', 'rv', any_of(st.STEP2_DELETE))} ELSE u END AS u FROM s3),
    s5 AS (SELECT term, rv, CASE WHEN u = w THEN {tail('u', 'rv', '(?:os|a|i|o|á|í|ó)$')}
        WHEN u LIKE '%ci' AND length(u) > rv THEN left(u, length(u) - 1) ELSE u END AS u FROM s4),
    s6 AS (SELECT term, CASE
        WHEN regexp_matches(u, '(?:gu|ci)[eéê]$') AND length(u) - 1 > rv THEN left(u, length(u) - 2)
        WHEN regexp_matches(u, '[eéê]$') AND length(u) > rv THEN left(u, length(u) - 1)
        WHEN u LIKE '%ç' THEN left(u, length(u) - 1) || 'c' ELSE u END AS u FROM s5),
    stems AS (SELECT term, replace(replace(u, 'a~', 'ã'), 'o~', 'õ') AS stem FROM s6)"""


FULL_WORDS = STOP + ", " + DOC_WORDS + """, labelled_words AS (
    SELECT d.doc_id AS id, CASE WHEN l.quality = 1 THEN 'pos' ELSE 'neg' END AS label, d.lang,
        unnest(d.w) AS term, generate_subscripts(d.w, 1) AS pos
    FROM doc_words d JOIN labels l ON d.doc_id = l.doc_id),
kept_words AS (SELECT k.* FROM labelled_words k ANTI JOIN stop s ON k.lang = s.lang AND k.term = s.term),
kept_terms AS (SELECT DISTINCT term FROM kept_words), """ + stems("kept_terms") + """,
stem_lists AS (SELECT k.id, list(s.stem ORDER BY k.pos) AS w
    FROM kept_words k JOIN stems s ON k.term = s.term GROUP BY k.id),
full_words AS (SELECT d.doc_id AS id, CASE WHEN l.quality = 1 THEN 'pos' ELSE 'neg' END AS label,
        coalesce(f.w, []) AS w
    FROM doc_words d JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN stem_lists f ON f.id = d.doc_id)"""
# The same preparation of every document, labelled or not.
ALL_FULL_WORDS = STOP + ", " + DOC_WORDS + """, word_places AS (
    SELECT doc_id AS id, lang, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM doc_words),
kept_words AS (SELECT k.* FROM word_places k ANTI JOIN stop s ON k.lang = s.lang AND k.term = s.term),
kept_terms AS (SELECT DISTINCT term FROM kept_words), """ + stems("kept_terms") + """,
stem_lists AS (SELECT k.id, list(s.stem ORDER BY k.pos) AS w
    FROM kept_words k JOIN stems s ON k.term = s.term GROUP BY k.id),
all_words AS (SELECT d.doc_id AS id, coalesce(f.w, []) AS w
    FROM doc_words d LEFT JOIN stem_lists f ON f.id = d.doc_id),
full_words AS (SELECT a.id, CASE WHEN l.quality = 1 THEN 'pos' ELSE 'neg' END AS label, a.w
    FROM all_words a JOIN labels l ON a.id = l.doc_id)"""
FULL_SCORES = (
    FULL_WORDS + ", " + bayes("full_words") + ", " + scored("mnb", "full_words") + ", "
    + scored("bnb", "full_words") + ", " + predictions("full_words")
)

# ---- lexicon ------------------------------------------------------------------------------------

# The learned lexicon uses every labelled review, so here the whole set is the training part.
VALENCES = REVIEW_WORDS + """, lex_terms AS (SELECT * FROM (SELECT id, label, unnest(w) AS term
        FROM review_words) WHERE length(term) >= 2),
lex_vocab AS (SELECT term FROM lex_terms GROUP BY term ORDER BY count(*) DESC, term LIMIT 1000),
lex_counts AS (SELECT v.term, count(*) FILTER (label = 'pos') AS pos, count(*) FILTER (label = 'neg') AS neg
    FROM lex_vocab v JOIN lex_terms t ON v.term = t.term GROUP BY v.term),
lex_logs AS (SELECT term, ln((pos + 1.0::DOUBLE) / (sum(pos) OVER () + count(*) OVER ())) AS lp,
    ln((neg + 1.0::DOUBLE) / (sum(neg) OVER () + count(*) OVER ())) AS ln_ FROM lex_counts),
valences AS (SELECT term, greatest(-4.0::DOUBLE, least(4.0::DOUBLE, round(lp - ln_, 1))) AS valence FROM lex_logs)"""


def pieces(text: str) -> str:
    """White-space pieces without outer punctuation unless two characters or fewer are left."""
    split = f"list_filter(string_split(trim({replaced(text, WS + '+', ' ')}), ' '), lambda x: x <> '')"
    core = f"trim(x, {quoted(lexicon.PUNCTUATION)})"
    return f"list_transform({split}, lambda x: CASE WHEN length({core}) <= 2 THEN x ELSE {core} END)"


def compound(total: str) -> str:
    return f"round({total} / sqrt({total} * {total} + 15.0::DOUBLE), 4)"


def plain_compound(source: str, text: str, key: str = "id") -> str:
    """CTEs that end in plain(key, compound)."""
    return f"""plain_words AS (SELECT {key} AS key, lower(unnest({pieces(text)})) AS term FROM {source}),
    plain_sums AS (SELECT s.{key} AS key, coalesce(sum(v.valence), 0.0::DOUBLE) AS total FROM {source} s
        LEFT JOIN plain_words p ON s.{key} = p.key LEFT JOIN valences v ON p.term = v.term GROUP BY s.{key}),
    plain AS (SELECT key, {compound('total')} AS compound FROM plain_sums)"""


def lexicon_label(value: str) -> str:
    return f"CASE WHEN {value} >= 0.05 THEN 'positivo' WHEN {value} <= -0.05 THEN 'negativo' ELSE 'neutro' END"


def context_compound(source: str, text: str, key: str = "id") -> str:
    """CTEs that end in context(key, compound): neighbours by window functions over word rows."""
    small = r"[^\p{Ll}\p{Lt}ªº]"

    def up(word):
        return f"regexp_full_match({word}, '{small}*\\p{{Lu}}{small}*')"

    idioms = " ".join(f"WHEN {quoted(k)} THEN {v}::DOUBLE" for k, v in lexicon.IDIOMS.items())

    def idiom(*cols):
        return f"CASE {' || chr(32) || '.join(cols)} {idioms} END"

    def negation(c):
        return f"({c} IN ({listed(lexicon.NEGATIONS)}) OR contains({c}, 'n''t'))"

    def boost(c, caps):
        loud = f"CASE WHEN {caps} AND mixed THEN CASE WHEN v > 0 THEN 0.733 ELSE -0.733 END ELSE 0.0 END"
        return f"""CASE WHEN {c} IN ({listed(lexicon.BOOSTERS)}) THEN CASE WHEN v < 0 THEN -0.293 ELSE 0.293 END + {loud}
            WHEN {c} IN ({listed(lexicon.DAMPENERS)}) THEN CASE WHEN v < 0 THEN 0.293 ELSE -0.293 END + {loud}
            ELSE 0.0 END::DOUBLE"""

    flips = {
        1: f"CASE WHEN {negation('p1')} THEN v * -0.74 ELSE v END",
        2: f"""CASE WHEN p2 = 'never' AND p1 IN ('so', 'this') THEN v * 1.25
            WHEN p2 = 'without' AND p1 = 'doubt' THEN v WHEN {negation('p2')} THEN v * -0.74 ELSE v END""",
        3: f"""CASE WHEN (p3 = 'never' AND p2 IN ('so', 'this')) OR p1 IN ('so', 'this') THEN v * 1.25
            WHEN p3 = 'without' AND (p2 = 'doubt' OR p1 = 'doubt') THEN v
            WHEN {negation('p3')} THEN v * -0.74 ELSE v END""",
    }
    pairs = ", ".join(quoted(x) for x in lexicon.DAMPENER_PAIRS)
    steps, before = [], "c2"
    for k, fade in ((1, "1.0"), (2, "0.95"), (3, "0.9")):
        on = f"(p{k} IS NOT NULL AND NOT k{k})"
        steps.append(f"""d{k} AS (SELECT * REPLACE (CASE WHEN {on}
            THEN v + {fade}::DOUBLE * {boost(f'p{k}', f'u{k}')} ELSE v END AS v) FROM {before}),
        e{k} AS (SELECT * REPLACE (CASE WHEN {on} THEN {flips[k]} ELSE v END AS v) FROM d{k})""")
        before = f"e{k}"
    return f"""ctx_texts AS (SELECT {key} AS key, {replaced(text, f'^{WS}+|{WS}+$', '')} AS said FROM {source}),
    ctx_docs AS (SELECT key, said, {pieces('said')} AS w FROM ctx_texts),
    ctx_marks AS (SELECT key, w,
        len(list_filter(w, lambda x: {up('x')})) AS caps,
        coalesce(list_position(list_transform(w, lambda x: lower(x)), 'but'), 0) AS but,
        least(length(said) - length(replace(said, '!', '')), 4) * 0.292::DOUBLE
        + CASE WHEN length(said) - length(replace(said, '?', '')) > 3 THEN 0.96
            WHEN length(said) - length(replace(said, '?', '')) > 1
            THEN (length(said) - length(replace(said, '?', ''))) * 0.18 ELSE 0.0 END::DOUBLE AS emphasis
        FROM ctx_docs),
    ctx_rows AS (SELECT key, caps > 0 AND caps < len(w) AS mixed, but, unnest(w) AS word,
        generate_subscripts(w, 1) AS place FROM ctx_marks),
    ctx_near AS (SELECT key, mixed, but, place, lower(word) AS term, {up('word')} AS u,
        lower(lag(word, 1) OVER o) AS p1, lower(lag(word, 2) OVER o) AS p2, lower(lag(word, 3) OVER o) AS p3,
        {up('lag(word, 1) OVER o')} AS u1, {up('lag(word, 2) OVER o')} AS u2, {up('lag(word, 3) OVER o')} AS u3,
        lower(lead(word, 1) OVER o) AS n1, lower(lead(word, 2) OVER o) AS n2
        FROM ctx_rows WINDOW o AS (PARTITION BY key ORDER BY place)),
    c0 AS (SELECT r.*, x.valence AS base, x1.term IS NOT NULL AS k1, x2.term IS NOT NULL AS k2,
        x3.term IS NOT NULL AS k3, y1.term IS NOT NULL AS kn FROM ctx_near r
        JOIN valences x ON r.term = x.term LEFT JOIN valences x1 ON r.p1 = x1.term
        LEFT JOIN valences x2 ON r.p2 = x2.term LEFT JOIN valences x3 ON r.p3 = x3.term
        LEFT JOIN valences y1 ON r.n1 = y1.term
        WHERE r.term NOT IN ({listed(lexicon.BOOSTERS)}, {listed(lexicon.DAMPENERS)})
        AND NOT (r.term = 'kind' AND coalesce(r.n1, '') = 'of')),
    c1 AS (SELECT *, CASE WHEN p1 = 'no' OR p2 = 'no' OR (p3 = 'no' AND p1 IN ('or', 'nor')) THEN base * -0.74
        WHEN term = 'no' AND kn THEN 0.0 ELSE base END::DOUBLE AS v FROM c0),
    c2 AS (SELECT * REPLACE (CASE WHEN u AND mixed THEN v + CASE WHEN v > 0 THEN 0.733 ELSE -0.733 END
        ELSE v END::DOUBLE AS v) FROM c1),
    {', '.join(steps)},
    f1 AS (SELECT * REPLACE (CASE WHEN p3 IS NOT NULL AND NOT k3 THEN coalesce(
            {idiom('term', 'n1', 'n2')}, {idiom('term', 'n1')}, {idiom('p1', 'term')},
            {idiom('p2', 'p1', 'term')}, {idiom('p2', 'p1')}, {idiom('p3', 'p2', 'p1')}, {idiom('p3', 'p2')}, v)
            + CASE WHEN p3 || ' ' || p2 IN ({pairs}) THEN -0.293 ELSE 0.0 END
            + CASE WHEN p2 || ' ' || p1 IN ({pairs}) THEN -0.293 ELSE 0.0 END ELSE v END::DOUBLE AS v) FROM e3),
    f2 AS (SELECT * REPLACE (CASE WHEN p1 = 'least' AND NOT k1 AND (p2 IS NULL OR p2 NOT IN ('at', 'very'))
        THEN v * -0.74 ELSE v END AS v) FROM f1),
    f3 AS (SELECT key, CASE WHEN but > 0 AND place < but THEN v * 0.5 WHEN but > 0 AND place > but THEN v * 1.5
        ELSE v END AS v FROM f2),
    ctx_sums AS (SELECT m.key, coalesce(s.total, 0.0::DOUBLE) AS total, m.emphasis FROM ctx_marks m
        LEFT JOIN (SELECT key, sum(v) AS total FROM f3 GROUP BY key) s ON m.key = s.key),
    ctx_total AS (SELECT key, CASE WHEN total > 0 THEN total + emphasis WHEN total < 0 THEN total - emphasis
        ELSE total END AS total FROM ctx_sums),
    context AS (SELECT key, {compound('total')} AS compound FROM ctx_total)"""


COMPARED = VALENCES + ", " + LABELLED_TURNS + ", " + plain_compound("turns", "texto") + f""", compared AS (
    SELECT l.*, {lexicon_label('p.compound')} AS sent_vader FROM labelled l JOIN plain p ON l.id = p.key)"""


def prompt(template: str, text: str) -> str:
    head, tail = template.split("{texto}")
    return f"{quoted(head)} || {text} || {quoted(tail)}"


# ---- queries ------------------------------------------------------------------------------------


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    page = "SELECT page_id, {} AS {} FROM pages"
    doc = "SELECT doc_id, {} AS {} FROM documents"
    sql["clean_tags_delete"] = page.format(tags("html"), "text")
    sql["clean_tags_space"] = page.format(tags("html", " "), "text")
    sql["strip_urls"] = page.format(replaced("html", f"https?://{NOT_WS}+", " "), "text")
    sql["collapse_whitespace"] = doc.format(f"trim({replaced('text', WS + '+', ' ')})", "text")
    sql["clean_text"] = page.format(cleaned("html"), "texto")
    sql["clean_text_documents"] = doc.format(cleaned("text"), "texto")
    sql["special_to_space"] = doc.format(replaced("text", r"[^\p{L}\p{N}]", " "), "text")
    sql["normalise_alnum_lower"] = doc.format(
        f"lower({replaced(tags('text'), '[^\\p{L}\\p{N}]', ' ')})", "text"
    )
    sql["drop_empty"] = "SELECT * FROM (" + page.format(cleaned("html"), "texto") + ") WHERE texto <> ''"
    sql["preview_180"] = f"""SELECT doc_id, CASE WHEN length(t) > 180 THEN substr(t, 1, 180) || '…' ELSE t END
        AS texto FROM (SELECT doc_id, {cleaned('text')} AS t FROM documents)"""

    sql["token_rejoin"] = with_(DOC_WORDS) + "SELECT doc_id, array_to_string(w, ' ') AS text FROM doc_words"
    sql["stop_words_rejoined"] = with_(STOP, DOC_WORDS) + """, lists AS (
        SELECT lang, list(term) AS s FROM stop GROUP BY lang)
        SELECT d.doc_id, array_to_string(list_filter(d.w, lambda x: NOT list_contains(l.s, x)), ' ') AS text
        FROM doc_words d JOIN lists l ON d.lang = l.lang"""
    sql["tokens_no_stopwords"] = with_(STOP, DOC_WORDS) + """, rows_ AS (SELECT lang, unnest(w) AS term,
            generate_subscripts(w, 1) - 1 AS pos FROM doc_words)
        SELECT r.lang, r.term, count(*) AS n, sum(r.pos)::BIGINT AS sum_pos FROM rows_ r
        ANTI JOIN stop s ON r.lang = s.lang AND r.term = s.term GROUP BY r.lang, r.term"""
    sql["term_frequencies"] = with_(DOC_WORDS, DOC_TERMS) + "SELECT term, count(*) AS n FROM doc_terms GROUP BY term"
    frequencies = with_(
        DOC_WORDS, DOC_TERMS, "freq AS (SELECT term, count(*) AS n FROM doc_terms GROUP BY term)", stems("freq")
    )
    sql["stem_vocabulary"] = frequencies + "SELECT f.term, f.n, s.stem FROM freq f JOIN stems s ON f.term = s.term"
    sql["stem_frequencies"] = frequencies + """SELECT s.stem AS term, sum(f.n)::BIGINT AS n
        FROM freq f JOIN stems s ON f.term = s.term GROUP BY s.stem"""
    sql["normalised_reviews"] = with_(FULL_WORDS) + "SELECT id, label, array_to_string(w, ' ') AS text FROM full_words"
    sql["bag_of_words"] = with_(DOC_WORDS, DOC_TERMS) + """SELECT doc_id, term, count(*) AS n
        FROM doc_terms GROUP BY doc_id, term"""
    sql["document_terms"] = with_(DOC_WORDS, DOC_TERMS, DOC_VOCAB) + """SELECT t.doc_id, v.term_idx, count(*) AS n
        FROM doc_terms t JOIN vocab v ON t.term = v.term GROUP BY t.doc_id, v.term_idx"""
    sql["vocabulary_top1000"] = with_(DOC_WORDS, DOC_TERMS, DOC_VOCAB) + "SELECT term, term_idx FROM vocab"
    sql["vocabulary_heavy"] = with_(DOC_WORDS, DOC_TERMS) + """SELECT term, count(*) AS n
        FROM doc_terms GROUP BY term ORDER BY n DESC, term LIMIT 1000"""
    sql["vocabulary_first50"] = sql["vocabulary_top1000"] + " ORDER BY term LIMIT 50"

    sql["label_map"] = """SELECT doc_id, CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN 'positivo'
        ELSE 'negativo' END AS sentiment FROM labels"""
    ids = "ids AS (SELECT doc_id AS id FROM documents)"
    sql["label_normalise"] = with_(ids, responses("ids")) + f"SELECT id, {lenient('answer')} AS label FROM responses"
    sql["label_strict"] = with_(ids, responses("ids")) + f"SELECT id, {strict('answer', 'error')} AS label FROM responses"
    sql["response_labels"] = with_(LABELLED_TURNS) + "SELECT * FROM labelled"
    sql["filter_by_label"] = sql["response_labels"] + " WHERE sent_gemini = 'neutro'"
    sql["filter_all_labels"] = sql["response_labels"]
    sql["response_labels_strict"] = with_(TURNS, responses("turns")) + f"""SELECT t.id,
        {strict('r.answer', 'r.error')} AS predicao_gemini FROM turns t LEFT JOIN responses r ON t.id = r.id"""

    sql["posts_to_texts"] = with_(FOUND_POSTS) + "SELECT * FROM post_texts"
    sql["all_posts_to_texts"] = with_(ALL_POSTS) + "SELECT * FROM post_texts"
    sql["top5_comments"] = with_(COMMENTS) + "SELECT * FROM first_comments"
    sql["find_posts"] = with_(FOUND) + "SELECT * FROM found"
    sql["comment_forest"] = "WITH RECURSIVE " + FOREST + """SELECT post_id, comment_id, depth::BIGINT AS depth,
        row_number() OVER (PARTITION BY post_id ORDER BY depth, path) AS place FROM forest"""
    sql["forest_to_texts"] = "WITH RECURSIVE " + ", ".join((TITLES, FOREST + FOREST_FIRST, texts_from("titles"))) + """
        SELECT * FROM post_texts"""
    sql["ranked_search"] = with_(TITLES, RANKED) + "SELECT * FROM ranked"
    sql["ranked_posts_to_texts"] = with_(ALL_POSTS, RANKED) + """SELECT r.keyword, r.rank, t.*
        FROM post_texts t JOIN ranked r ON r.post_id = t.post_id"""
    sql["row_ids"] = with_(ALL_POSTS) + """SELECT row_number() OVER (ORDER BY post_id, pos) AS id,
        post_id, pos, origem FROM post_texts"""
    sql["row_ids_within_post"] = with_(ALL_POSTS) + """SELECT row_number() OVER (PARTITION BY post_id ORDER BY pos)
        AS id, post_id, pos, origem FROM post_texts"""
    sql["row_count"] = with_(ALL_POSTS) + "SELECT count(*) AS n FROM post_texts"

    sql["split_hash"] = f"SELECT doc_id, {IS_TEST.replace('id::', 'doc_id::')} AS is_test FROM documents"
    sql["sample_n"] = "SELECT doc_id, text FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 10"

    sql["nb_priors"] = with_(PLAIN_BAYES) + "SELECT label, n, round(log_prior, 6) AS log_prior FROM priors"
    for name, kind in (("multinomial", "mnb"), ("bernoulli", "bnb")):
        sql[f"nb_{name}_weights"] = with_(PLAIN_BAYES) + f"SELECT label, term, round(weight, 6) AS weight FROM {kind}"
        sql[f"nb_{name}_scores"] = with_(PLAIN_SCORES) + f"SELECT id, label, score FROM {kind}_scores"
    sql["nb_gaussian_predict"] = with_(PLAIN_BAYES, GAUSSIAN) + f"SELECT * FROM {best('gnb_scores')}"
    everything = "all_words AS (SELECT doc_id AS id, w FROM doc_words)"
    sql["nb_predict"] = with_(PLAIN_BAYES, everything, scored("bnb", "all_words")) + f"""
        SELECT id AS doc_id, prediction FROM {best('bnb_scores')}"""
    sql["nb_full_predict"] = with_(ALL_FULL_WORDS, bayes("full_words"), scored("bnb", "all_words")) + f"""
        SELECT id AS doc_id, prediction FROM {best('bnb_scores')}"""
    sql["nb_model_accuracy"] = with_(PLAIN_SCORES, predictions("review_words")) + """SELECT model, count(*) AS n,
        round(avg((label = prediction)::INT::DOUBLE), 6) AS accuracy FROM predictions GROUP BY model"""
    merged = REVIEW_WORDS + ", " + bayes(vocabulary_of="train_terms")
    sql["nb_merged_weights"] = with_(merged) + "SELECT label, term, round(weight, 6) AS weight FROM bnb"
    sql["nb_merged_predict"] = with_(merged, scored("mnb"), GAUSSIAN) + f"""
        SELECT 'multinomial' AS model, * FROM {best('mnb_scores')} UNION ALL SELECT 'gaussian', * FROM {best('gnb_scores')}"""
    sql["nb_train_vocabulary"] = with_(TRAIN_VOCAB_SCORES, predictions("review_words")) + "SELECT * FROM predictions"
    sql["train_and_evaluate"] = with_(FULL_SCORES) + "SELECT * FROM predictions"
    sql["train_label_counts"] = with_(FULL_SCORES) + """SELECT model, prediction AS label, count(*) AS n,
        count_if(label = prediction)::BIGINT AS n_right FROM predictions GROUP BY model, prediction"""
    sql["model_round_trip"] = with_(PLAIN_BAYES) + """SELECT b.term, b.label, round(b.weight, 6) AS weight, v.term_idx
        FROM bnb b JOIN vocab v ON b.term = v.term"""

    plain_docs = with_(VALENCES, plain_compound("documents", "text", "doc_id"))
    sql["lexicon_compound"] = plain_docs + "SELECT key AS doc_id, compound FROM plain"
    sql["lexicon_label"] = plain_docs + f"SELECT key AS doc_id, {lexicon_label('compound')} AS sent_vader FROM plain"
    sql["lexicon_context"] = with_(VALENCES, context_compound("documents", "text", "doc_id")) + """
        SELECT key AS doc_id, compound FROM context"""
    sql["lexicon_context_turns"] = with_(VALENCES, TURNS, context_compound("turns", "texto")) + """
        SELECT key AS id, compound FROM context"""

    emoji_turns = """emoji_turns AS (SELECT id,
        replace(replace(texto, ' the ', '😀 '), ' and ', ' 🙁') AS texto FROM turns),
    emoji_signs AS (SELECT id, string_split(texto, '') AS signs FROM emoji_turns),
    emoji_said AS (SELECT id, array_to_string(list_transform(signs, lambda s, i:
        CASE WHEN s IN ('😀', '🙁') THEN CASE WHEN i > 1 AND signs[i - 1] <> ' ' THEN ' ' ELSE '' END
            || CASE s WHEN '😀' THEN 'very the' ELSE 'and not' END ELSE s END), '') AS texto FROM emoji_signs)"""
    sql["emoji_as_words"] = with_(TURNS, emoji_turns) + "SELECT id, texto FROM emoji_said"
    sql["lexicon_context_emoji"] = with_(VALENCES, TURNS, emoji_turns, context_compound("emoji_said", "texto")) + """
        SELECT key AS id, compound FROM context"""

    sql["prompt_render"] = with_(TURNS) + f"SELECT id, {prompt(external.THREE_CLASS_PROMPT, 'texto')} AS prompt FROM turns"
    sql["prompt_review"] = f"SELECT page_id, {prompt(external.TWO_CLASS_PROMPT, tags('html'))} AS prompt FROM pages"
    sql["answers_kept"] = with_(TURNS, "asked AS (SELECT DISTINCT texto FROM turns WHERE substr(md5(id), 1, 1) < '8')") + f"""
        SELECT t.id, {scorer('t.texto')} AS sent_gemini, CASE WHEN contains(t.texto, '?') THEN NULL
            WHEN a.texto IS NOT NULL THEN 'first' ELSE 'second' END AS run
        FROM turns t LEFT JOIN asked a ON a.texto = t.texto"""
    sql["scorer_map"] = with_(TURNS) + f"SELECT *, {scorer('texto')} AS sent_gemini FROM turns"
    sql["classify_and_compare"] = with_(COMPARED) + "SELECT * FROM compared"

    sql["answered_only"] = with_(ANSWERED) + "SELECT * FROM answered WHERE prediction IN ('positivo', 'negativo')"
    sql["accuracy_coverage"] = with_(ANSWERED) + """, flags AS (SELECT prediction IN ('positivo', 'negativo') AS ok,
            sentiment = prediction AS hit FROM answered), shares AS (SELECT count(*) AS n,
            count_if(ok)::BIGINT AS n_answered, avg(ok::INT::DOUBLE) AS coverage,
            avg(CASE WHEN ok THEN hit::INT::DOUBLE END) AS accuracy FROM flags)
        SELECT n, n_answered, round(coverage, 6) AS coverage, round(accuracy, 6) AS accuracy,
            format('{:.2f}%', 100 * accuracy) AS shown FROM shares"""
    sql["accuracy"] = with_(ANSWERED) + """SELECT round(avg((sentiment = prediction)::INT::DOUBLE), 6) AS accuracy
        FROM answered WHERE prediction IN ('positivo', 'negativo')"""
    sql["confusion"] = with_(ANSWERED, KEPT) + """SELECT sentiment AS label, prediction, count(*) AS n
        FROM kept GROUP BY sentiment, prediction"""
    sql["classification_report"] = with_(ANSWERED, KEPT) + """, classes AS (
            SELECT sentiment AS class FROM kept UNION SELECT prediction FROM kept),
        per AS (SELECT class,
            (SELECT count(*) FROM kept WHERE sentiment = class AND prediction = class) AS tp,
            (SELECT count(*) FROM kept WHERE sentiment = class) AS support,
            (SELECT count(*) FROM kept WHERE prediction = class) AS predicted FROM classes),
        prf AS (SELECT class, tp, support,
            CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0.0 END AS p,
            CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0.0 END AS r,
            CASE WHEN predicted + support > 0 THEN 2 * tp::DOUBLE / (predicted + support) ELSE 0.0 END AS f FROM per)
        SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score, support FROM prf
        UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp)::DOUBLE / sum(support), 6), sum(support)::BIGINT FROM prf
        UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)::BIGINT FROM prf
        UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6),
            round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6),
            sum(support)::BIGINT FROM prf"""
    sql["head_of_result"] = sql["answered_only"] + " ORDER BY id LIMIT 10"
    sql["unanswered_listing"] = with_(MARKED) + "SELECT id, sentiment, 'erro' AS prediction FROM marked ORDER BY id LIMIT 10"
    sql["label_counts"] = with_(LABELLED_TURNS) + "SELECT sent_gemini AS label, count(*) AS n FROM labelled GROUP BY 1"
    sql["label_counts_by_scorer"] = with_(COMPARED) + """SELECT scorer, label, count(*) AS n FROM (
        SELECT 'sent_gemini' AS scorer, sent_gemini AS label FROM compared
        UNION ALL SELECT 'sent_vader', sent_vader FROM compared) GROUP BY scorer, label"""
    sql["table_profile"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS type, count(*) AS rows, count({c}) AS non_null FROM documents"""
        for c, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))
    )
    sql["merged_profile"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS type, count(*) AS rows, count({c}) AS non_null,
            count(DISTINCT {c}) AS "distinct" FROM documents"""
        for c, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))
    )
    sql["processed_head"] = with_(FULL_WORDS) + """SELECT f.id, f.label, d.text, array_to_string(f.w, ' ') AS processed
        FROM full_words f JOIN documents d ON d.doc_id = f.id ORDER BY f.id LIMIT 5"""
    sql["text_lengths"] = """SELECT count(text) AS n, min(length(text))::BIGINT AS shortest,
        max(length(text))::BIGINT AS longest FROM documents"""

    sql["reviews_csv_scan"] = """SELECT d.text AS text_pt, CASE WHEN l.quality = 1 THEN 'pos' ELSE 'neg' END AS sentiment
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
    sql["csv_round_trip"] = with_(ALL_POSTS) + "SELECT 'manual' AS origem, texto FROM post_texts"
    sql["raw_export_ids"] = with_(ALL_POSTS) + """SELECT row_number() OVER (ORDER BY post_id, pos) AS id, texto
        FROM post_texts"""
    sql["raw_export_by_keyword"] = with_(ALL_POSTS) + """SELECT origem AS keyword,
        row_number() OVER (PARTITION BY origem ORDER BY post_id, pos) AS id, texto FROM post_texts"""
    sql["labelled_file_counts"] = sql["label_counts"]
    sql["run_search"] = with_(
        VALENCES, FOUND_POSTS,
        "found_texts AS (SELECT row_number() OVER (ORDER BY post_id, pos) AS id, origem, texto FROM post_texts)",
        plain_compound("found_texts", "texto"),
    ) + f"""SELECT t.id, t.origem, t.texto, {scorer('t.texto')} AS sent_gemini, {lexicon_label('p.compound')} AS sent_vader
        FROM found_texts t JOIN plain p ON t.id = p.key"""
    sql["run_file"] = with_(TURNS) + "SELECT 'manual' AS origem, texto FROM turns"
    sql["check_answers"] = f"""SELECT id, CASE label WHEN 'pos' THEN 'positivo' ELSE 'negativo' END AS sentiment,
        CASE WHEN contains(t, '?') THEN 'erro' WHEN contains(t, 'the') THEN 'nao_classificado'
            WHEN contains(t, ' and ') THEN 'negativo' ELSE 'nao_classificado' END AS predicao_gemini
        FROM (SELECT d.doc_id AS id, {tags('d.text')} AS t, CASE WHEN l.quality = 1 THEN 'pos' ELSE 'neg' END AS label
            FROM documents d JOIN labels l ON d.doc_id = l.doc_id
            ORDER BY md5('42:' || d.doc_id::VARCHAR), d.doc_id LIMIT 10)"""
    sql["stream_classify"] = with_(TURNS) + f"SELECT 'manual' AS origem, texto, {scorer('texto')} AS sent_gemini FROM turns"
    sql["stream_counts_kept"] = f"SELECT sent_gemini AS label, count(*) AS n FROM ({sql['stream_classify']}) GROUP BY 1"
    sql["stream_label_counts"] = f"SELECT sent_gemini AS label, count(*) AS n FROM ({sql['stream_classify']}) GROUP BY 1"
    return sql
