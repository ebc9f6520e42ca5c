"""Toxicity: a gapped-subsequence string kernel with Nystroem landmarks and a linear support vector machine."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .text import filled, from_driver, slices, small_batches, texts, to_tasks

#: Letters of the kernel: a-z and 13 classes for all others; a code of three letters indexes a table.
LETTERS = 40
#: Offsets of the second and third letter of a subsequence, at most two letters skipped, and the decay of each skip.
GAPS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
DECAY = 0.6
#: Longer words are scored in windows of so many letters that overlap by half.
WIDE = 48
LEET = str.maketrans("013457$@!|", "oieastsail")
SIGNS = re.compile(r"[\W\d_]+")
REMEMBERED = 400_000


def unit(token: str) -> str:
    """A word as the kernel sees it: lower case, digits and signs that stand for letters replaced inside words, others dropped."""
    if token.isascii() and token.isalpha():
        return token
    core = token.strip(".,;:!?\"'()[]{}*#%&|-")
    if any(c.isalpha() for c in core):
        core = core.translate(LEET)
    return SIGNS.sub("", core)


def tokens(text: str) -> list[str]:
    """Words of a lower-cased text; three or more single letters in a row also count as the word they spell."""
    words = text.lower().split()
    if any(len(w) == 1 for w in words):
        words += ["".join(run) for short, run in ((k, list(g)) for k, g in groupby(words, lambda w: len(w.strip(".,-_*")) == 1)) if short and len(run) > 2]
    return words


def codes(word: str) -> np.ndarray:
    raw = np.frombuffer(word.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return np.where((raw >= 97) & (raw <= 122), raw - 96, 27 + raw % 13)


def windows(word: str) -> list[str]:
    return [word] if len(word) <= WIDE else [word[i : i + WIDE] for i in range(0, len(word) - WIDE // 2, WIDE // 2)]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised kernel features of words of one padded length: codes and values, one row a word."""
    size = max(map(len, words)) + 4
    grid = np.zeros((len(words), size), np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    grid[np.arange(size) < lengths[:, None]] = codes("".join(words))
    n = size - 4
    cs, vs = [], []
    for i, j in GAPS:
        a, b, c = grid[:, :n], grid[:, i : i + n], grid[:, j : j + n]
        ok = (b > 0) & (c > 0)
        cs.append(np.where(ok, (a * LETTERS + b) * LETTERS + c, 0))
        vs.append(np.where(ok, DECAY ** (j - 2), 0.0))
    code, value = np.concatenate(cs, axis=1), np.concatenate(vs, axis=1)
    # Equal codes of a word add up: sort them together and keep each sum at its last place.
    order = np.argsort(code, axis=1)
    code, value = np.take_along_axis(code, order, 1), np.take_along_axis(value, order, 1)
    total = np.cumsum(value, axis=1)
    last = np.ones(code.shape, bool)
    last[:, :-1] = code[:, 1:] != code[:, :-1]
    before = np.where(last, total, 0.0)
    before = np.maximum.accumulate(before, axis=1)
    summed = np.where(last, total - np.concatenate([np.zeros((len(words), 1)), before[:, :-1]], axis=1), 0.0)
    norm = np.sqrt((summed**2).sum(axis=1, keepdims=True))
    return code, summed / np.where(norm > 0, norm, 1)


class Kernel:
    """The machine in kernel form, folded into one weight per subsequence: f(x) = w . phi(x) + bias.

    With landmarks z and Nystroem features K(x, z) K(z, z)^(-1/2), the linear machine's decision is a weighted sum of
    kernels with the landmarks. The kernel is an inner product of explicit subsequence weights, so that sum is one table.
    """

    def __init__(self, weights: np.ndarray, bias: float, slope: float, middle: float):
        self.weights, self.bias, self.slope, self.middle = weights, bias, slope, middle

    def decide(self, words: list[str]) -> np.ndarray:
        """Decisions for units; a unit of fewer than three letters has only the bias."""
        out = np.array([-np.inf if len(w) > 2 else self.bias for w in words])
        by: dict[int, tuple[list[int], list[str]]] = {}
        for i, w in enumerate(words):
            for piece in windows(w):
                if len(piece) > 2:
                    at, ws = by.setdefault((len(piece) + 3) // 4, ([], []))
                    at.append(i)
                    ws.append(piece)
        for at, ws in by.values():
            for lo in range(0, len(ws), 4_000):
                code, value = features(ws[lo : lo + 4_000])
                np.maximum.at(out, at[lo : lo + 4_000], (self.weights[code] * value).sum(axis=1) + self.bias)
        return out

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (decision - self.middle), -30, 30)))


def nystroem(words: list[str], landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the words, and the matrix that turns a machine over them into subsequence weights."""
    z = np.zeros((len(landmarks), LETTERS**3), np.float32)
    for i, w in enumerate(landmarks):
        code, value = features([w[:WIDE]])
        np.add.at(z[i], code[0], value[0].astype(np.float32))
    z[:, 0] = 0
    values, vectors = np.linalg.eigh((z @ z.T).astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    zt = np.ascontiguousarray(z.T)
    k = np.zeros((len(words), len(landmarks)), np.float32)
    order = np.argsort([len(w) for w in words], kind="stable")
    for lo in range(0, len(words), 500):
        rows = order[lo : lo + 500]
        code, value = features([words[i][:WIDE] for i in rows])
        for col in np.flatnonzero(value.any(axis=0)):
            k[rows] += zt[code[:, col]] * value[:, col : col + 1].astype(np.float32)
    return (k @ root).astype(float), root.astype(np.float32) @ z


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Primal support vector machine with squared hinge loss by Newton steps over the rows inside the margin."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    ridge = np.r_[np.full(x.shape[1], 0.2), 1e-3]
    active = None
    for _ in range(rounds):
        inside = y * (x1 @ w) < 1
        if active is not None and (inside == active).all():
            break
        active = inside
        a, s = x1[inside], weight[inside]
        w = np.linalg.solve(np.diag(ridge) + c * (a.T * s) @ a, c * (a.T * s) @ y[inside])
    return w[:-1], w[-1]


def grams(word: str) -> set[str]:
    edged = f"^{word[:WIDE]}$"
    return {edged[i : i + n] for n in (4, 5) for i in range(len(edged) - n + 1)} | {edged}


def telling(toxic: list[list[str]], clean: Counter, share: float, least: float) -> set[str]:
    """Units of toxic documents that a telling piece marks: whole words or runs of 4 and 5 letters in toxic documents alone.

    A piece in n toxic documents would be missing from all clean ones by chance with probability share^n; it tells from
    e^-least on, and if units with it stand in clean documents in at most 2 % as many places.
    """
    pieces = {u: grams(u) for u in {u for us in toxic for u in us if u not in clean}}
    count = Counter(g for us in toxic for g in set().union(*[pieces[u] for u in us if u in pieces]))
    kept = {g: n for g, n in count.items() if n * -np.log(share) >= least}
    against: Counter = Counter()
    for u, n in clean.items():
        for g in grams(u) & kept.keys():
            against[g] += n
    good = {g for g, n in kept.items() if against[g] <= 0.02 * n}
    return {u for u, gs in pieces.items() if gs & good}


def fit(bags: list[tuple[int, list[str]]], share: float, landmarks: int = 240, negatives: int = 4000, rounds: int = 3) -> Kernel:
    """Learn from labelled documents as bags of units, of which a toxic one has at least one toxic unit.

    Rounds alternate between naming the toxic units (first by telling pieces, then also those that the machine of the last
    round finds) and training on them against units of clean documents, the hardest ones included. `share`, the toxic
    share among all labelled rows, is the score where one label is missing; else the rarer label weighs more in the scores, by the square root of the odds.
    """
    toxic, clean = [us for y, us in bags if y], [us for y, us in bags if not y]
    if not toxic or not clean:
        p = min(max(share, 0.01), 0.99)
        return Kernel(np.zeros(LETTERS**3), 0.0, 1.0, -float(np.log(p / (1 - p))))
    seen_t, seen_c = Counter(u for us in toxic for u in us), Counter(u for us in clean for u in us)
    chance, least = len(toxic) / len(bags), 13.0
    named = telling(toxic, seen_c, chance, least)
    while not named and least > 1:
        least -= 2
        named = telling(toxic, seen_c, chance, least)
    pool = sorted(seen_c, key=lambda u: (-seen_c[u], u))
    only = sorted(set(seen_t) - set(seen_c))
    spread = pool[: negatives // 3] + pool[negatives // 3 :: max(1, len(pool) * 3 // (2 * negatives))]
    hard: list[str] = []
    for step in range(rounds):
        pos = sorted(named, key=lambda u: (-seen_t[u], u))[:1500] or [""]
        neg = list(dict.fromkeys(hard + spread))
        half = landmarks // 2
        marks = dict.fromkeys(pos[: half // 2] + pos[half // 2 :: max(1, len(pos) // (half // 2))][: half // 2] + neg[:: max(1, len(neg) // half)][:half])
        weight = np.r_[[10.0 + min(seen_t[u], 90) for u in pos], np.full(len(neg), 10.0)]
        x, back = nystroem(pos + neg, list(marks))
        w, b = machine(x, np.r_[np.ones(len(pos)), -np.ones(len(neg))], weight)
        kernel = Kernel(w @ back, b, 4.0, 0.0)
        if step < rounds - 1:
            found = dict(zip(only, kernel.decide(only)))
            for us in toxic:
                if not any(u in named for u in us):
                    best = max(((found[u], u) for u in us if u in found), default=(-9, ""))
                    if best[0] > 0:
                        named.add(best[1])
            worst = kernel.decide(pool)
            hard = list(dict.fromkeys(hard + [pool[i] for i in np.argsort(-worst)[:1500]]))
    top = np.array([kernel.decide(us).max() if us else kernel.bias for _, us in bags])
    label = np.array([y for y, _ in bags], float)
    kernel.slope, kernel.middle = curve(top, label, np.where(label == 1, np.sqrt((1 - label.mean()) / label.mean()), 1.0))
    return kernel


def curve(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and middle of the logistic curve over decisions with the least log loss, targets smoothed by 1 %."""
    target = np.where(y == 1, 0.99, 0.01)
    best = (np.inf, 4.0, 0.0)
    for slope in (1, 1.5, 2, 3, 4, 6, 8):
        for middle in np.linspace(f.min(), f.max(), 81):
            p = 1 / (1 + np.exp(-np.clip(slope * (f - middle), -30, 30)))
            best = min(best, (round(float(-(weight * (target * np.log(p) + (1 - target) * np.log1p(-p))).sum()), 6), float(slope), float(middle)))
    return best[1], best[2]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in slices(batches, "body"):
        found = [sorted({u for t in set(tokens(body)) if len(u := unit(t)) > 2}) for body in texts(table, "body")]
        yield from pa.table([table.column("y"), pa.array(found, pa.list_(pa.string()))], names=["y", "units"]).to_batches()


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", sample: int = 1500) -> Kernel:
    """Fit on at most `sample` documents of each label for which `usable` holds, those whose ids hash lowest; null labels are left out."""
    known = labels.select("doc_id", F.col(f"`{label}`").cast("int").alias("y")).filter("y IS NOT NULL").filter(usable).groupBy("doc_id").agg(F.max("y").alias("y"))
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    few = [known.filter(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for v in (1, 0)]
    rows = docs.select("doc_id", filled().alias("body")).join(few[0].unionAll(few[1]), "doc_id").select("y", "body")
    # One string object for each distinct unit, document by document.
    bags = [(r[0], [sys.intern(u) for u in r[1]]) for r in rows.mapInArrow(_bags, "y int, units array<string>").toLocalIterator()]
    return fit(sorted(bags), total["t"] / max(1, total["n"]))


def score(docs: DataFrame, kernel: Kernel, text: str = "text", out: str = "score") -> DataFrame:
    """All columns and `out`: the score of each whole text, which is that of its most toxic word.

    Null and empty texts score as texts without any word of three letters; repeated rows repeat; a column named `out` is
    replaced. The table of subsequence weights has a fixed size and goes to every task.
    """
    small_batches(docs.sparkSession)
    sent = to_tasks(docs.sparkSession, kernel)
    kept = [f for f in docs.schema.fields if f.name != out]
    schema = StructType([*kept, StructField(out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = from_driver(sent)
        memory: dict[str, float] = {}
        for part in slices(batches, text):
            bags = [set(tokens(body)) for body in texts(part, text)]
            fresh = set().union(*bags)
            new = list(fresh - memory.keys())
            if len(memory) + len(new) > REMEMBERED:
                memory, new = {}, list(fresh)
            memory.update(zip(new, known.decide([unit(t) for t in new]).tolist()))
            top = np.array([max(map(memory.__getitem__, bag), default=known.bias) for bag in bags])
            yield from pa.table([*[part.column(f.name) for f in kept], pa.array(known.probability(top), pa.float64())], names=schema.names).to_batches()

    return docs.mapInArrow(run, schema)
