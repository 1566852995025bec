"""Fences follow the group: the same text goes in a clean group and stays in a noisy one."""

import math

from opinaria.llm import rules
from opinaria.sources.scratch import materialise


def body(i, repeated):
    """100 words, of which about ``repeated`` lie in windows that occur twice; one line per ten words."""
    words = [f"w{i}x{j}" for j in range(100)]
    words[:repeated] = (["aa", "bb", "cc"] * 40)[:repeated]
    return "\n".join(" ".join(words[k : k + 10]) for k in range(0, 100, 10))


def lines(i, repeated):
    rows = [" ".join(f"v{i}x{j}x{k}" for k in range(10)) for j in range(10)]
    return "\n".join(rows[: 10 - repeated] + [rows[0]] * repeated)


def test_a_zero_quartile_range_leaves_a_fence_of_the_group(spark):
    rows = []
    for i in range(300):
        rows.append((i, body(i, 0), "en", "clean"))
        rows.append((1000 + i, body(i, 15 if i % 8 == 0 else 0), "en", "noisy"))
        rows.append((2000 + i, lines(i, 2 if i % 8 == 0 else 0), "en", "lists"))
    for k, source in enumerate(("clean", "noisy", "lists")):
        rows += [(5000 + k, body(999, 15), "en", source), (6000 + k, lines(999, 1), "en", source)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    kept = {r["doc_id"]: r["kept"] for r in rules.query(df).collect()}
    assert not kept[5000] and kept[5001]  # repeated words
    assert not kept[6000] and kept[6002]  # repeated lines
    assert all(kept[i] for i in range(300))


def exact(values, q):
    """The least value with at least that share of the values up to it."""
    ordered = sorted(values)
    return ordered[max(math.ceil(q * len(ordered) - 1e-9), 1) - 1]


def brute_fences(rows):
    """Fences by sorted lists; ``rows`` are those that passed the base rules."""
    def leaning(group, wider, c, q):
        return wider + (exact([r[c] for r in group], q) - wider) * len(group) / (len(group) + rules.LEAN)

    def at(key, c, q):
        in_lang = [r for r in rows if r["_lang"] == key[0]]
        own = [r for r in in_lang if r["_source"] == key[1]]
        return leaning(own, leaning(in_lang, exact([r[c] for r in rows], q), c, q), c, q)

    out = {}
    for key in {(r["_lang"], r["_source"]) for r in rows}:
        for side, sign, both in (("upper", 1, rules.UPPER), ("lower", -1, rules.LOWER)):
            for c, (outer, inner) in both.items():
                reach = max(rules.MARGIN * abs(at(key, c, outer) - at(key, c, inner)), rules.FLOOR)
                out[(*key, f"{side}_{c}")] = at(key, c, outer) + sign * reach
    return out


def mixed(n):
    rows = []
    for i in range(n):
        text = body(i, 12 if i % 9 == 0 else 0) if i % 2 else lines(i, i % 3) + " #" * (i % 5)
        rows.append((i, text + " long" * (i % 4) + ("x" * 600 if i % 23 == 0 else ""), ("en", "de", None)[i % 3], f"s{i % 7 % 2}"))
    return [*rows, (n, "few words", "en", "s0"), (n + 1, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string"


def test_kept_equals_exact_quantiles(spark):
    # Sketches of up to 200 values are exact.
    df = spark.createDataFrame(mixed(150), SCHEMA).repartition(3)
    rows = [r.asDict() for r in rules.judged(df).collect()]
    passed = [r for r in rows if not r["base_failed"]]
    limits = brute_fences(passed)
    for r in rows:
        within = not r["base_failed"] and all(r[c] <= limits[r["_lang"], r["_source"], f"upper_{c}"] for c in rules.UPPER) and all(
            r[c] >= limits[r["_lang"], r["_source"], f"lower_{c}"] for c in rules.LOWER)
        assert r["kept"] == within
    assert 0 < sum(r["kept"] for r in rows) < len(passed)


def test_one_text_more_moves_a_fence_little(spark):
    def fence(n):
        rows = [(i, body(i, 15 if i % 8 == 0 else 0), "en", "noisy") for i in range(n)]
        rows += [(1000 + i, body(i, 0), "de", "clean") for i in range(400)]
        found = materialise(rules.measured(spark.createDataFrame(rows, SCHEMA).repartition(2)), "measured")
        parts = materialise(rules.sketches(found), "parts")
        return next(r["upper_repeat_share"] for r in rules.fences(parts).collect() if r["_source"] == "noisy")

    before, after = fence(199), fence(200)
    assert abs(after - before) < 0.002 and before > 0.05
