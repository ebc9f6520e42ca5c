"""Katz model over several blocks and buckets, and what its exchanges hold."""

import math
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shipsight.llm import katz

COMMON = [f"w{i}" for i in range(300)]


def model(train):
    """log10 P(w | h) straight from the definition."""
    u, b = Counter(w for s in train for w in s), Counter(p for s in train for p in zip(["<s>", *s], s))
    d1, d2 = (katz.discounts([sum(v == r for v in n.values()) for r in range(1, 7)]) for n in (u, b))
    cut = lambda d, c: (d[c] if c <= katz.TRUSTED else 1.0) * c
    total = sum(u.values())
    held = sum(cut(d1, c) for c in u.values())
    n = total if held < total else total + 1
    p1 = lambda w: cut(d1, u[w]) / n if u[w] else 1 - held / n
    after = {}
    for (h, w), c in b.items():
        after.setdefault(h, {})[w] = c

    def logp(h, w):
        if h not in after:
            return math.log10(p1(w))
        seen, ch = sum(cut(d2, c) for c in after[h].values()), sum(after[h].values())
        m = ch if seen < ch - 1e-9 else ch + 1
        return math.log10(cut(d2, after[h][w]) / m if w in after[h] else (1 - seen / m) / (1 - sum(map(p1, after[h]))) * p1(w))

    return logp


def test_histories_of_every_kind_over_blocks(spark):
    rng = random.Random(3)
    weights = [1 / (i + 1) for i in range(300)]  # the most frequent histories are spread, most others are not
    docs = [" ".join(rng.choices(COMMON, weights, k=rng.randint(1, 40))) for _ in range(400)]
    docs = [f"{t} pre fix" if i % 20 < 3 else t for i, t in enumerate(docs)]  # "pre" has one follower, which is not discounted
    docs[7::40] = ["w1 pre w2 new pre fix"] * 10  # held out: an unseen word after it, an unknown word, and the seen one
    rows = [(i, t) for i, t in enumerate(docs)]
    trained = F.col("doc_id") % 40 != 7
    got = {r.doc_id: r.score for r in katz.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), trained).collect()}
    seqs = [(i, [*t.split(), "\n"]) for i, t in rows]
    train = [s for i, s in seqs if i % 40 != 7]
    pairs = Counter(p for s in train for p in zip(s, s[1:]))
    assert {w: c > katz.TRUSTED for (h, w), c in pairs.items() if h == "pre"} == {"fix": True}
    assert sum(s.count("pre") for s in train) * 4 * 16 < sum(map(len, train))  # in one bucket of 16 or more
    logp = model(train)
    assert got == {i: pytest.approx(sum(logp(h, w) for h, w in zip(["<s>", *s], s))) for i, s in seqs}


def test_exchanges_hold_no_documents(spark, monkeypatch):
    """What is written beside the blocks holds a block's bigrams once, however many of its documents hold them."""
    written = []

    def settled(*args, settle=katz.settle, **named):
        out = settle(*args, **named)
        written.append(sum(x.stat().st_size for x in Path(out.settled_at).rglob("*.parquet")))
        return out

    monkeypatch.setattr(katz, "settle", settled)
    rng = random.Random(5)
    texts = [" ".join(rng.choices(COMMON, k=60)) for _ in range(400)]
    sizes = []
    for times in (1, 10):
        katz.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts * times)], "doc_id long, text string").coalesce(1), F.lit(True))
        sizes.append(written[-1])
    assert sizes[1] < 1.5 * sizes[0]
