"""Quality classifier: a sparse ensemble of tree-path rules over text statistics, compiled to Spark columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import filled

#: Character classes whose share of the text is a statistic.
CLASSES = {"upper": r"[^\p{Lu}]+", "digit": r"[^0-9]+", "mark": r"[^#$%&*|~^<>{}\[\]\\/_=+@]+", "bang": r"[^!?]+", "stop": r"[^.,;:]+", "foreign": r"[\x00-\x7F]+"}
Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold) that hold together


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, all inside the JVM; an empty text has zeros."""
    n = F.greatest(F.length(text), F.lit(1))
    words, lines = F.split(text, r"\s+"), F.split(text, "\n")
    n_words, n_lines = F.size(words), F.size(lines)
    out = {name: F.length(F.regexp_replace(text, pattern, "")) / n for name, pattern in CLASSES.items()}
    return out | {
        "chars": F.log1p(F.length(text).cast("double")),
        "word_length": F.length(text) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "line_length": F.log1p(F.length(text) / n_lines),
    }


class RuleModel:
    """Intercept, rules and their weights; `score` is the probability of label 1 as a column over the statistics."""

    def __init__(self, names: list[str], intercept: float, rules: list[Rule], weights: list[float]):
        self.names, self.intercept, self.rules, self.weights = names, intercept, rules, weights

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights):
            held = F.lit(True)
            for k, above, cut in rule:
                c = F.col(self.names[k])
                held = held & ((c > F.lit(cut)) if above else (c <= F.lit(cut)))
            total = total + F.when(held, F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) if above else (x[:, k] <= cut)
    return out


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, path: Rule, depth: int, found: list[tuple[Rule, float]], value: np.ndarray) -> None:
    """Split by the best gain of second-order boosting; every node but the root gives a rule."""
    lam = 1.0
    G, H = g[rows].sum(), h[rows].sum()
    if path:
        found.append((path, 0.0))
    best = (1e-3, None)
    if depth:
        for k, points in enumerate(cuts):
            if not len(points):
                continue
            at = np.searchsorted(points, x[rows, k], side="left")
            gl = np.cumsum(np.bincount(at, g[rows], len(points) + 1))[:-1]
            hl = np.cumsum(np.bincount(at, h[rows], len(points) + 1))[:-1]
            gain = gl**2 / (hl + lam) + (G - gl) ** 2 / (H - hl + lam) - G**2 / (H + lam)
            gain[(hl < 1) | (H - hl < 1)] = 0
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], (k, float(points[i])))
    if best[1] is None:
        value[rows] = -G / (H + lam)
        return
    k, cut = best[1]
    above = x[rows, k] > cut
    grow(x, g, h, cuts, rows[~above], (*path, (k, False, cut)), depth - 1, found, value)
    grow(x, g, h, cuts, rows[above], (*path, (k, True, cut)), depth - 1, found, value)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 25, depth: int = 3, lasso: float = 2e-4, steps: int = 600) -> RuleModel:
    """Boosted trees give the rules, an L1-penalised logistic regression over them (accelerated proximal steps) the weights."""
    prior = (y.sum() + 1) / (len(y) + 2)
    constant = RuleModel(names, float(np.log(prior / (1 - prior))), [], [])
    if not len(y) or y.min() == y.max():
        return constant
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 49))) for k in range(x.shape[1])]
    f = np.zeros(len(y))
    found: list[tuple[Rule, float]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        value = np.zeros(len(y))
        grow(x, p - y, np.maximum(p * (1 - p), 1e-6), cuts, np.arange(len(y)), (), depth, found, value)
        f += 0.3 * value
    rules = list(dict.fromkeys(r for r, _ in found))
    if not rules:
        return constant
    m = np.stack([holds(x, r) for r in rules], axis=1).astype(float)
    keep = (m.mean(axis=0) > 0) & (m.mean(axis=0) < 1)
    rules, m = [r for r, k in zip(rules, keep) if k], m[:, keep]
    size = 4.0 / (np.linalg.norm(np.c_[m, np.ones(len(y))], 2) ** 2 / len(y))
    w, b = np.zeros(m.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = (1 / (1 + np.exp(-(m @ v + c))) - y) / len(y)
        nw = v - size * (m.T @ r)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - size * lasso, 0)
        nb = c - size * r.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    used = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(names, b, [rules[i] for i in used], w[used].tolist())


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", sample: int = 20_000) -> RuleModel:
    """Fit on at most `sample` labelled rows for which `usable` holds: those whose ids hash lowest. Null labels are left out."""
    known = labels.select(F.col("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).filter("y IS NOT NULL").filter(usable).groupBy("doc_id").agg(F.max("y").alias("y"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    stats = statistics(F.col("body"))
    rows = docs.select("doc_id", filled().alias("body")).join(few, "doc_id").select("y", *[c.alias(k) for k, c in stats.items()]).toPandas()
    return fit(rows[list(stats)].to_numpy(float), rows["y"].to_numpy(float), list(stats))


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id and score (probability of label 1) of each whole text; null is empty text, repeated rows repeat."""
    stats = statistics(F.col("body"))
    return docs.select("doc_id", filled().alias("body")).select("doc_id", *[c.alias(k) for k, c in stats.items()]).select("doc_id", model.score().alias("score"))
