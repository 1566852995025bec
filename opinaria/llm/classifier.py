"""Quality classifier as a sparse ensemble of rules over text statistics.

Small boosted trees are grown on a bounded sample of labelled rows; the path to every node is a rule,
a conjunction of comparisons; a logistic regression with an L1 penalty keeps the rules that matter.
The rules and their weights become one Spark column expression, which scores every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# At most so many labelled rows are fitted on, chosen by a hash of their ids.
SAMPLE = 20_000
TREES, DEPTH, LEAST_LEAF, RATE = 24, 3, 8, 0.3
PENALTIES = (0.02, 0.01, 0.005, 0.002)
THRESHOLD = 0.7
Rule = tuple[tuple[str, bool, float], ...]


def features(text: Column) -> dict[str, Column]:
    """Statistics of a text; none looks at an id, a language tag, a source or a label."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.split(text, "\n")
    n = F.greatest(F.length(text), F.lit(1))
    n_words = F.greatest(F.size(words), F.lit(1))

    def without(characters: str) -> Column:
        return F.length(text) - F.length(F.translate(text, characters, ""))

    return {
        "n_chars": F.length(text).cast("double"),
        "n_words": F.size(words).cast("double"),
        "mean_word": F.length(text) / n_words,
        "upper": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n,
        "symbols": without("#*$%&|<>@{}[]=+~^_\\") / n,
        "shouts": without("!?") / n,
        "digits": without("0123456789") / n,
        "stops": without(".,;:") / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_chars": F.length(text) / F.size(lines),
    }


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
    """Best (gain, feature, threshold) of one node by first and second derivatives."""
    best = (1e-6, -1, 0.0)
    total = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], g[order].cumsum(), h[order].cumsum()
        left = np.arange(1, len(v))
        ok = (v[1:] > v[:-1]) & (left >= LEAST_LEAF) & (len(v) - left >= LEAST_LEAF)
        if not ok.any():
            continue
        gl, hl = gs[:-1], hs[:-1]
        gain = np.where(ok, gl**2 / (hl + 1.0) + (gs[-1] - gl) ** 2 / (hs[-1] - hl + 1.0) - total, -np.inf)
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (float(gain[i]), f, float((v[i] + v[i + 1]) / 2))
    return best


def grow(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 7) -> list[Rule]:
    """The rules of all nodes of boosted trees, each on half of the rows."""
    rnd, score, rules = np.random.default_rng(seed), np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        rows = rnd.permutation(len(y))[: max(len(y) // 2, min(len(y), 4 * LEAST_LEAF))]
        step = np.zeros(len(y))

        def node(inside: np.ndarray, rule: Rule, depth: int, p=p, step=step) -> None:
            part = np.intersect1d(rows, np.flatnonzero(inside), assume_unique=True)
            g, h = y[part] - p[part], p[part] * (1 - p[part])
            if rule:
                rules[rule] = None
            gain, f, cut = _split(x[part], g, h) if depth < DEPTH and len(part) >= 2 * LEAST_LEAF else (0, -1, 0)
            if f < 0:
                step[inside] = g.sum() / (h.sum() + 1.0)
                return
            low = x[:, f] <= cut
            node(inside & low, (*rule, (names[f], True, cut)), depth + 1)
            node(inside & ~low, (*rule, (names[f], False, cut)), depth + 1)

        node(np.ones(len(y), dtype=bool), (), 0)
        score += RATE * step
    return list(rules)


def applied(rules: list[Rule], x: np.ndarray, names: list[str]) -> np.ndarray:
    at = {name: i for i, name in enumerate(names)}
    columns = [np.logical_and.reduce([(x[:, at[f]] <= cut) == low for f, low, cut in rule]) for rule in rules]
    return np.stack(columns, 1).astype(float) if columns else np.zeros((len(x), 0))


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an L1 penalty, by accelerated proximal steps."""
    z = np.hstack([np.ones((len(z), 1)), z])
    rate = 4 * len(y) / max(np.linalg.norm(z, 2) ** 2, 1e-9)
    w = v = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(rounds):
        step = v - rate * z.T @ (1 / (1 + np.exp(-z @ v)) - y) / len(y)
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new[0] = step[0]
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[Rule]
    weights: list[float]

    def score(self, columns: dict[str, Column]) -> Column:
        """The probability of label 1 as one column expression."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for name, low, cut in rule:
                test = columns[name] <= F.lit(cut)
                holds = holds & (test if low else ~test)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleEnsemble:
    """Rules and weights; the penalty is the one with the least loss on a fifth of the rows.

    Without rows, or with one label only, no rule is kept and the score is (ones + 1) / (rows + 1):
    where nothing was marked as bad, nothing is rejected.
    """
    ones, n = float(y.sum()), len(y)
    if ones in (0, n) or n < 4 * LEAST_LEAF:
        share = min((ones + 1) / (n + 1), 1 - 1e-9)
        return RuleEnsemble(float(np.log(share / (1 - share))), [], [])
    rules = grow(x, y, names)
    z = applied(rules, x, names)
    check = np.arange(n) % 5 == 0
    losses = []
    for penalty in PENALTIES:
        b, w = lasso(z[~check], y[~check], penalty)
        p = np.clip(1 / (1 + np.exp(-(b + z[check] @ w))), 1e-6, 1 - 1e-6)
        losses.append(-np.mean(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)))
    b, w = lasso(z, y, PENALTIES[int(np.argmin(losses))])
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble(b, [rules[i] for i in kept], [float(w[i]) for i in kept])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE) -> RuleEnsemble:
    """Fit on at most ``sample`` labelled rows, those with the least hash of their ids."""
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(
        F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    columns = features(F.col("_text"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(
        F.broadcast(chosen), "_id").select("_id", "_label", *(c.alias(n) for n, c in columns.items()))
    got = sorted(rows.collect())
    values = np.array([r[2:] for r in got], dtype=float).reshape(len(got), len(columns))
    return fit(values, np.array([r[1] for r in got], dtype=float), list(columns))


def scored(docs: DataFrame, model: RuleEnsemble, text_col: str = "text") -> DataFrame:
    """(row struct, score): every row; null and empty texts are scored by their statistics, all zero."""
    columns = features(F.col("_row").getField(text_col).cast("string"))
    rows = docs.select(F.struct("*").alias("_row"))
    measured = rows.select("_row", F.struct(*(c.alias(n) for n, c in columns.items())).alias("_f"))
    used = {name: F.col("_f").getField(name) for name in columns}
    return measured.select(F.col("_row").alias("row"), model.score(used).alias("score"))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training; a row without an id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    rows = scored(docs.select("doc_id", "text"), model)
    return rows.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier does not reject, with all their columns."""
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    return scored(docs, model).filter(F.col("score") >= THRESHOLD).select("row.*")
