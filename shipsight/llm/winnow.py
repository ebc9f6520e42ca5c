"""Benchmark contamination by winnowed fingerprints, extended to exact word matches."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import filled, from_driver, slices, small_batches, to_tasks

#: Bytes as they stand in words: A-Z lower-cased, all other ASCII but digits and letters become spaces, the rest stays.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split(b" ")


def clean_words(text: str) -> list[bytes]:
    return [w for w in words_of(text) if w]


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each run of k word numbers."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h ^ ids[i : i + n]) * MIX
            h ^= h >> np.uint64(29)
    return h


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Sorted positions of the minimum (the rightmost of equals) of each `window` consecutive hashes."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.empty(0, np.int64)
    wins = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(wins)) + window - 1 - np.argmin(wins[:, ::-1], axis=1))


class Fingerprints:
    """Benchmark passages by winnowed k-gram hashes; `spans` finds where their windows occur in a list of words."""

    def __init__(self, items: list[tuple[str, str]], span: int, k: int):
        self.span, self.k, self.window = span, k, span - k + 1
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], set[str]] = defaultdict(set)
        found: dict[int, set[int]] = defaultdict(set)
        for item_id, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in clean_words(text))
            if not ids:
                continue
            size = min(span, len(ids))
            for i in range(len(ids) - size + 1):
                self.windows[ids[i : i + size]].add(item_id)
            h = gram_hashes(np.array(ids, np.uint64), min(k, size))
            picked = winnow(h, self.window) if size == span else np.arange(len(h))[:1]
            found[(min(k, size), size < span)].update(h[picked].tolist())
        self.sizes = sorted({len(w) for w in self.windows})
        self.tables = {key: np.array(sorted(v), np.uint64) for key, v in found.items()}

    def spans(self, words: list[bytes]) -> list[tuple[int, int, set[str]]]:
        """(start, end, items) of every occurrence of a window.

        Full windows: any run of `span` words of the text shares its winnowed hash with the benchmark's equal run, so each
        hit is within one window of a common fingerprint and is confirmed word by word. Shorter items are looked up by
        their first k words at every position.
        """
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.uint64, len(words))
        if not ids.any():
            return []
        out, plain = [], ids.tolist()
        for (k, short), table in self.tables.items():
            h = gram_hashes(ids, k)
            if not len(h):
                continue
            at = np.flatnonzero(np.isin(h, table)) if short else None
            if short:
                for size in (s for s in self.sizes if s < self.span and min(self.k, s) == k):
                    out += self._confirm(plain, at, size)
            else:
                picked = winnow(h, self.window)
                hits = picked[np.isin(h[picked], table)]
                near = np.unique((hits[:, None] + np.arange(-self.window + 1, 1)).ravel())
                out += self._confirm(plain, near, self.span)
        return out

    def _confirm(self, ids: list[int], starts: np.ndarray, size: int) -> list[tuple[int, int, set[str]]]:
        ok = starts[(starts >= 0) & (starts <= len(ids) - size)].tolist()
        return [(i, i + size, self.windows[w]) for i in ok if (w := tuple(ids[i : i + size])) in self.windows]


def _pass(docs: DataFrame, bench: DataFrame, parts: int, part: int, span: int, k: int) -> DataFrame:
    """Add the hit word ranges and items of one share of the benchmark to the columns `ranges` and `items`."""
    rows = bench.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()  # bounded: see find()
    prints = to_tasks(docs.sparkSession, Fingerprints([(r[0], r[1]) for r in rows], span, k))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = from_driver(prints)
        for table in slices(batches, "body"):
            ranges, items, sizes = table.column("ranges").to_pylist(), table.column("items").to_pylist(), []
            for i, body in enumerate(table.column("body").to_pylist()):
                words = clean_words(body)
                sizes.append(len(words))
                got = known.spans(words)
                if got:
                    ranges[i] = merged(ranges[i] + [x for a, b, _ in got for x in (a, b)])
                    items[i] = sorted(set(items[i]).union(*[s for *_, s in got]))
            new = {"ranges": ranges, "items": items, "n_words": sizes}
            yield from pa.table([pa.array(new[f.name], f.type) if f.name in new else table.column(f.name) for f in table.schema], schema=table.schema).to_batches()

    return docs.mapInArrow(run, schema)


def merged(flat: list[int]) -> list[int]:
    """Start, end, start, end ... of the union of such ranges."""
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find(docs: DataFrame, benchmark: DataFrame, span: int = 13, k: int = 6, share: int = 20, max_bytes: int = 32_000_000) -> DataFrame:
    """All columns of `docs` plus n_words, ranges (hit words, start and end in turn), items, contaminated.

    A fingerprint is the minimum k-gram hash of every span - k + 1 consecutive ones, so two equal runs of `span` words always
    share one. The benchmark's fingerprints and windows go to the tasks in shares of at most about `max_bytes` of text (its
    size is measured first); a larger benchmark takes more passes over each slice of documents, in the same stage, so
    documents are never shuffled. A document is contaminated when hits make up 1/`share` of its words or more.

    Null text has no words; items without words match nothing; an item shorter than `span` is one window as a whole. Repeated
    rows are judged alike, tied or repeated item ids count once, an empty benchmark gives no hits. Columns of `docs` with the
    names of the new ones are replaced.
    """
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), filled().alias("text"))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("s")).first()["s"]
    own = {"body": filled(), "n_words": F.lit(0).cast("long"), "ranges": F.array().cast("array<int>"), "items": F.array().cast("array<string>")}
    kept = [c for c in docs.columns if c not in (*own, "n_hit", "contaminated")]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(n) for n, c in own.items()])
    small_batches(docs.sparkSession)
    parts = max(1, math.ceil(size / max_bytes))
    for part in range(parts):
        out = _pass(out, bench, parts, part, span, k)
    hit = F.aggregate(F.transform("ranges", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda s, x: s + x).cast("long")
    return out.withColumn("n_hit", hit).select(
        *[F.col(f"`{c}`") for c in kept], "n_words", "n_hit", "ranges", "items", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")
    )
