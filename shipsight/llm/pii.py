"""Personal data: fixed patterns, and a skip-chain conditional random field that adds consistent further mentions."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .secrets import SPANS
from .text import filled, from_driver, slices, small_batches, texts, to_tasks

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CANDIDATE = re.compile(r"\S*[0-9@]\S*")


def emails(body: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part reaches back to the end of the last match or foreign character."""
    low, at = 0, body.find("@")
    while at >= 0:
        start = low + len(body[low:at].rstrip(LOCAL))
        m = DOMAIN.match(body, at + 1) if start < at else None
        if m:
            yield start, m.end()
        low = m.end() if m else at + 1
        at = body.find("@", low)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(body: str) -> list[tuple[str, int, int]]:
    out = [("email", i, j) for i, j in emails(body)]
    # No digit before a match: an attempt inside a run of digits fails wherever the one at its start did.
    out += [("ip", m.start(), m.end()) for m in IP.finditer(body) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups())]
    for m in CARD.finditer(body):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 64 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in body:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(body) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def shape(token: str) -> str:
    """Runs of digits, letters and signs, with the length of digit runs."""
    kinds = re.sub(r"[^\W\d_]+", "a", token[:80])
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", kinds)


def features(token: str, before: str, after: str) -> list[str]:
    digits = sum(c.isdigit() for c in token)
    return ["bias", f"shape={shape(token)}", f"digits={min(digits, 20)}", f"at={'@' in token}", f"dots={min(token.count('.'), 4)}", f"plus={token[:1] == '+'}", f"before={shape(before)[:12]}", f"after={shape(after)[:12]}", f"head={token[:1]}", f"equals={'=' in token or ':' in token}"]


def candidates(body: str) -> list[tuple[int, int, str]]:
    """Tokens with a digit or @; only these can be personal data of the four kinds."""
    return [(m.start(), m.end(), m[0]) for m in CANDIDATE.finditer(body)] if re.search("[0-9@]", body) else []


def core(token: str) -> str:
    return re.sub(r"[^0-9a-z@.]", "", token.lower()).strip(".")


class Field:
    """Weights of a field over candidate tokens: `unary` (feature x label), chain and skip potentials (label x label)."""

    def __init__(self, names: dict[str, int], unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.names, self.unary, self.chain, self.skip = names, unary, chain, skip

    def local(self, tokens: list[tuple[int, int, str]]) -> np.ndarray:
        text = [t[2] for t in tokens]
        rows = [[self.names[f] for f in features(t, text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else "") if f in self.names] for i, t in enumerate(text)]
        return np.array([self.unary[r].sum(axis=0) for r in rows])

    def marginals(self, tokens: list[tuple[int, int, str]], rounds: int = 8, damping: float = 0.3) -> np.ndarray:
        """Loopy sum-product messages in log form over chain edges and skip edges, all edges of a round at once.

        A skip edge joins each token to the previous one of the same core (the token without signs), or of the same digits.
        So k mentions have k - 1 edges, and a long document stays linear.
        """
        n = len(tokens)
        own = self.local(tokens)
        edges = [(i, i + 1, 0) for i in range(n - 1) if tokens[i + 1][0] - tokens[i][1] <= 40]
        for key in (core, lambda t: re.sub(r"\D", "", t)):
            last: dict[str, int] = {}
            for i, t in enumerate(tokens):
                k = key(t[2])
                if len(k) >= 6:
                    if k in last:
                        edges.append((last[k], i, 1))
                    last[k] = i
        if not edges:
            return _softmax(own)
        e = np.array(edges)
        src, dst, kind = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]]), np.concatenate([e[:, 2], e[:, 2]])
        table = np.stack([self.chain, self.skip])
        pot = table[kind]
        half = len(e)
        pot[half:] = pot[half:].transpose(0, 2, 1)
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        msg = np.zeros((2 * half, len(LABELS)))
        for _ in range(rounds):
            belief = own.copy()
            np.add.at(belief, dst, msg)
            out = (belief[src] - msg[back])[:, :, None] + pot
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            msg = damping * msg + (1 - damping) * new
        belief = own.copy()
        np.add.at(belief, dst, msg)
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def labelled(body: str) -> tuple[list[tuple[int, int, str]], list[int]]:
    tokens = candidates(body)
    spans = sorted((i, j, LABELS.index(k)) for k, i, j in base_spans(body))
    labels = [next((k for i, j, k in spans if i < stop and start < j), 0) for start, stop, _ in tokens]
    return tokens, labels


def train(docs: DataFrame, text: str = "text", sample: int = 3000, steps: int = 150, skip_weight: float = 2.5) -> Field:
    """Fit the field on a bounded sample: the `sample` documents with a digit or @ whose ids hash lowest.

    All tokens of these documents count; equal examples reach the driver once, with how often they occur. Labels are the
    base spans. Unary weights by L2 logistic regression, chain potentials as smoothed log odds of neighbouring
    labels, skip potentials as an agreement bonus. No rows, or no labelled token, give a field that adds nothing.
    """
    rows = docs.select("doc_id", filled(f"`{text}`").alias("body")).filter(F.col("body").rlike("[0-9@]")).orderBy(F.xxhash64("doc_id"), "body").limit(sample)
    examples = rows.mapInArrow(_examples, "feats array<string>, label int, next int, n long")
    found = sorted(tuple(r) for r in examples.groupBy("feats", "label", "next").agg(F.sum("n")).collect())
    names: dict[str, int] = {}
    counts: dict[str, int] = defaultdict(int)
    for feats, _, _, times in found:
        for f in feats:
            counts[f] += times
    for f in sorted(counts):
        if counts[f] >= 2:
            names[f] = len(names)
    n, k = len(names), len(LABELS)
    unary = np.zeros((n, k))
    pairs = np.ones((k, k))
    flat = [[names[x] for x in feats if x in names] for feats, *_ in found]
    for _, y, after, times in found:
        if after >= 0:
            pairs[y, after] += times
    if len({y for _, y, *_ in found}) > 1:
        at = np.array([i for i, f in enumerate(flat) for _ in f])
        col = np.array([c for f in flat for c in f])
        want = np.eye(k)[[y for _, y, *_ in found]]
        weight = np.array([[times] for *_, times in found], float)
        m = np.zeros_like(unary)
        for step in range(steps):
            score = np.zeros((len(flat), k))
            np.add.at(score, at, unary[col])
            grad = np.zeros_like(unary)
            np.add.at(grad, col, (weight * (_softmax(score) - want))[at])
            m = 0.9 * m + grad / weight.sum() + 1e-5 * unary
            unary -= 2.0 * m
    freq = pairs.sum(axis=1) / pairs.sum()
    chain = 0.5 * np.log(pairs / pairs.sum() / (freq[:, None] * freq[None, :]))
    return Field(names, unary, np.clip(chain, -2, 2), skip_weight * np.eye(k))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each feature list occurs with its label and the label of the next token, -1 at the end of a text."""
    for table in slices(batches, "body"):
        seen: Counter = Counter()
        for body in texts(table, "body"):
            tokens, ys = labelled(body)
            t = [x[2] for x in tokens]
            seen.update((tuple(features(x, t[i - 1] if i else "", t[i + 1] if i + 1 < len(t) else "")), ys[i], ys[i + 1] if i + 1 < len(t) else -1) for i, x in enumerate(t))
        feats, labels, after = zip(*seen) if seen else ((), (), ())
        yield from pa.table([pa.array(feats, pa.list_(pa.string())), pa.array(labels, pa.int32()), pa.array(after, pa.int32()), pa.array(seen.values(), pa.int64())], names=["feats", "label", "next", "n"]).to_batches()


def find(docs: DataFrame, field: Field, text: str = "text", least: float = 0.9) -> DataFrame:
    """doc_id and spans (kind, start, stop, base) in code points.

    Base spans are the fixed patterns. A candidate token whose marginal of some kind reaches `least` and that no base span
    overlaps is added without its outer signs; so a mention that the patterns miss (another spelling, a lost sign) follows
    the clear mentions of the same document. The field judges every document with a candidate, whether a pattern hit it or not, as
    it was trained on both. Null is empty text, with no spans; repeated rows repeat; other columns are
    ignored. Work is linear in the text: tokens, chain edges and skip edges to the previous mention.
    """
    small_batches(docs.sparkSession)
    sent = to_tasks(docs.sparkSession, field)  # a fixed number of features and labels, bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = from_driver(sent)
        for table in slices(batches):
            rows = []
            for body in texts(table):
                tokens = candidates(body)
                spans = base_spans(body) if tokens else []
                rows.append([dict(kind=k, start=i, stop=j, base=True) for k, i, j in spans])
                if tokens:
                    rows[-1] += added(known, tokens, spans, least)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())]))
            yield from pa.table([table.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"]).to_batches()

    return docs.selectExpr("doc_id", f"`{text}` AS text").mapInArrow(run, SPANS)


def added(field: Field, tokens: list[tuple[int, int, str]], spans: list[tuple[str, int, int]], least: float) -> list[dict]:
    if all(any(i < b and a < j for _, i, j in spans) for a, b, _ in tokens):
        return []
    p = field.marginals(tokens)
    out, ordered = [], sorted((i, j) for _, i, j in spans)
    starts = np.array([i for i, _ in ordered])
    stops = np.maximum.accumulate(np.array([j for _, j in ordered]))
    for (a, b, token), row in zip(tokens, p):
        best = int(np.argmax(row))
        before = int(np.searchsorted(starts, b)) - 1
        if best and row[best] >= least and (before < 0 or stops[before] <= a):
            a, b = a + len(token) - len(token.lstrip("\"'(<[{,;:=")), b - len(token) + len(token.rstrip("\"')>]},;:.!?=#$%&*"))
            if a < b:
                out.append(dict(kind=LABELS[best], start=a, stop=b, base=False))
    return out
