"""Katz backoff language model: Good-Turing discounted bigrams, exactly normalised backoff weights.

Texts become blocks of word numbers that are written once. Counting and scoring exchange packed number arrays between
blocks and hash buckets of n-grams, so each n-gram of a block crosses the network once each way, whatever its frequency:

1. a block asks the word buckets for its words, which answer with ids and training counts;
2. it asks the bigram buckets for its bigrams, which answer with training counts, and with what backoff weights need for
   the histories that have unseen words there; these answers are written once, and counts of counts beside them;
3. each block evaluates its bigrams. Documents and sums never leave their block.

There is a bucket for every four blocks at least (and for every shuffle partition), so that no bucket holds more than about
four blocks' share of the bigrams, while messages stay long. A history with more than a quarter of a mean bucket's
tokens is spread over several buckets; the few sums that its backoff weight needs (at most four histories a bucket) are
added up and broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.settle import settle
from .text import filled, from_driver, slices, small_batches, to_tasks

#: Counts above are not discounted.
TRUSTED = 5
END = b"\n"  # no word holds white space
MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCK_CHARS = 6_000_000


#: Arrays of fewer bytes together share a compressed frame.
SMALL = 16_384


def planes(a: np.ndarray, rising: bool = False) -> bytes:
    """Unsigned numbers in as few byte planes as they need; rising ones as differences."""
    a = np.ascontiguousarray(a, np.uint64)
    if rising and len(a):
        a = np.diff(a, prepend=np.uint64(0))
    size = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([size, rising]) + np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def numbers(b: bytes) -> np.ndarray:
    size, rising = b[0], b[1]
    rows = np.frombuffer(b, np.uint8, offset=2).reshape(size, -1)
    out = np.zeros((rows.shape[1], 8), np.uint8)
    out[:, :size] = rows.T
    a = out.view(np.uint64).reshape(-1)
    return np.cumsum(a, dtype=np.uint64) if rising else a


def pack(a: np.ndarray, rising: bool = False) -> bytes:
    return zstandard.compress(planes(a, rising), 3)


def unpack(b: bytes) -> np.ndarray:
    return numbers(zstandard.decompress(b))


def bundle(first: np.ndarray, *others: np.ndarray) -> bytes:
    """Several arrays in one, the first of rising numbers. In short ones a frame for each would outweigh the numbers."""
    parts = [planes(first, True), *map(planes, others)]
    few = sum(map(len, parts)) < SMALL
    if not few:
        parts = [zstandard.compress(x, 3) for x in parts]
    body = np.array([len(x) for x in parts], np.uint32).tobytes() + b"".join(parts)
    return bytes([few, len(parts)]) + (zstandard.compress(body, 3) if few else body)


def unbundle(b: bytes) -> list[np.ndarray]:
    few, n = b[0], b[1]
    body = zstandard.decompress(b[2:]) if few else b[2:]
    ends = np.cumsum([4 * n, *np.frombuffer(body, np.uint32, n)]).tolist()
    return [(numbers if few else unpack)(body[i:j]) for i, j in zip(ends, ends[1:])]


def mixed(a: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        a = (a ^ (a >> np.uint64(31))) * MIX
        return a ^ (a >> np.uint64(29))


def table(rows: list[tuple], schema: pa.Schema) -> list[pa.RecordBatch]:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema).to_batches()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("block", pa.string()), ("ids", pa.binary()), ("nulls", pa.binary()), ("lens", pa.binary()), ("train", pa.binary()), ("toks", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary())])
    task = TaskContext.get()
    for n, part in enumerate(slices(batches, "body", BLOCK_CHARS)):
        index: dict = defaultdict()
        index.default_factory = index.__len__
        end = index[END]
        runs = []
        for body in part.column("body").to_pylist():
            words = body.encode("utf-8", "replace").lower().split()
            runs.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
            runs.append(np.array([end]))
        toks = np.concatenate(runs)
        lens = np.array([len(r) + 1 for r in runs[::2]])
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
        order = np.argsort(hashes)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        toks = rank[toks]
        train = np.array(part.column("train").to_pylist(), bool)
        counts = np.bincount(toks[np.repeat(train, lens)], minlength=len(order))
        ids = part.column("doc_id")
        raw = np.array(ids.fill_null(0).to_pylist(), np.int64)
        yield from table([(f"{task.partitionId()}-{n}", zstandard.compress(raw.tobytes()), pack(np.array(ids.is_null().to_pylist())), pack(lens), pack(train), pack(toks), pack(hashes[order], True), pack(counts))], schema)


BLOCKS = "block string, ids binary, nulls binary, lens binary, train binary, toks binary, hashes binary, counts binary"


def _ask(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("block", pa.string()), ("hashes", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for r in batch.to_pylist():
                hashes, counts = unpack(r["hashes"]), unpack(r["counts"])
                cuts = np.searchsorted((hashes >> np.uint64(64 - bits)).astype(np.int64), np.arange(2**bits + 1))
                yield from table([(b, r["block"], pack(hashes[i:j], True), pack(counts[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j], schema)

    return run


def _answer(n_buckets: int) -> Callable:
    """Ids and counts of the words that each block asked for; one row without a block has counts of counts, tokens, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.string()), ("bucket", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("stats", pa.list_(pa.int64()))])
        end = xxhash.xxh64_intdigest(END)
        for batch in batches:
            for r in batch.to_pylist():
                asked = [unpack(x["hashes"]) for x in r["asks"]]
                words, back = np.unique(np.concatenate(asked), return_inverse=True)
                counts = np.bincount(back, np.concatenate([unpack(x["counts"]) for x in r["asks"]]).astype(float), len(words)).astype(np.int64)
                # Frequent words get small ids, which pack well.
                ids = np.empty(len(words), np.int64)
                ids[np.argsort(-counts, kind="stable")] = np.arange(len(words)) * n_buckets + r["bucket"] + 1
                known = counts[counts > 0]
                ends = int(counts[words == np.uint64(end)].sum())
                rows: list[tuple] = [(None, r["bucket"], b"", b"", [*np.bincount(np.minimum(known, TRUSTED + 2), minlength=TRUSTED + 3)[1 : TRUSTED + 2].tolist(), int(known.sum()), len(known), ends])]
                at = 0
                for x, a in zip(r["asks"], asked):
                    own = back[at : at + len(a)]
                    at += len(a)
                    rows.append((x["block"], r["bucket"], pack(ids[own]), pack(counts[own]), None))
                yield from table(rows, schema)

    return run


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Katz's d_r for r = 0 .. TRUSTED from n_1 .. n_(TRUSTED + 1); where the estimate is undefined or not in (0, 1), (r - 0.5) / r."""
    n = [0, *counts_of_counts]
    out = np.ones(TRUSTED + 1)
    share = (TRUSTED + 1) * n[TRUSTED + 1] / n[1] if n[1] else 1.0
    for r in range(1, TRUSTED + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share) if n[r] and share != 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Model:
    """Counts that every task needs: tokens, words, discounts of both orders, and sums of the spread histories."""

    def __init__(self, stats: list[int], n_buckets: int):
        self.n_buckets = n_buckets
        self.tokens, self.words, self.docs = stats[TRUSTED + 1 :]
        self.d1 = discounts(stats[: TRUSTED + 1])
        # What discounts take from seen words is the probability of the unknown word; without any discount, one more count.
        held = sum(n * r * self.d1[r] for r, n in zip(range(1, TRUSTED + 1), stats)) + self.tokens - sum(n * r for r, n in zip(range(1, TRUSTED + 1), stats))
        self.total = self.tokens if 0 < held < self.tokens else self.tokens + 1
        self.unknown = 1 - held / self.total if self.tokens else 1.0
        self.d2 = np.ones(TRUSTED + 1)
        #: Spread histories by number, their followers by count, sums of their followers' unigrams.
        self.spread = np.zeros(0, np.uint64), np.zeros((0, TRUSTED), np.int64), np.zeros(0)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d1[np.minimum(c, TRUSTED)] ** (c <= TRUSTED) * c / self.total, self.unknown)

    def pieces(self, ch: np.ndarray) -> np.ndarray:
        """Over how many buckets a history's bigrams are spread."""
        return 1 + (ch.astype(np.int64) * 4 * self.n_buckets) // max(1, self.tokens)

    def bucket(self, h: np.ndarray, w: np.ndarray, ch: np.ndarray) -> np.ndarray:
        more = mixed(w).astype(np.int64) % np.minimum(self.pieces(ch), self.n_buckets)
        return (mixed(h).astype(np.int64) + more) % self.n_buckets

    def bigram(self, h: np.ndarray, ch: np.ndarray, cw: np.ndarray, c: np.ndarray, own: tuple, small: tuple, lower: tuple) -> np.ndarray:
        """P(w | h) from the counts of history, word and pair, and each bucket's histories with their followers by count and unigram sums.

        A history whose followers all go undiscounted gets one more count for the rest; an unseen one backs off fully. One
        that is in none of `own` has a discounted follower, and no unseen one here.
        """
        own = np.concatenate([*own, self.spread[0]])
        small = np.concatenate([*(x.reshape(TRUSTED, -1).T for x in small), self.spread[1]]).astype(np.int64)
        lower = np.concatenate([*(x.view(np.float64) for x in lower), self.spread[2]])
        order = np.argsort(own)
        own, small, lower = np.r_[own[order], np.uint64(2**64 - 1)], np.r_[small[order], np.zeros((1, TRUSTED), np.int64)], np.r_[lower[order], 0.0]
        at = np.searchsorted(own, h)
        here = (own[at] == h) & (ch > 0)
        total = np.maximum(ch + (here & ~small.any(1)[at]), 1)
        taken = (small @ (np.arange(1, TRUSTED + 1) * (1 - self.d2[1:])))[at] + total - ch  # what unseen words share
        alpha = np.where(ch > 0, taken / total / np.maximum(1 - lower[at], 1e-12), 1.0)
        return np.where(c > 0, c * self.d2[np.minimum(c, TRUSTED)] ** (c <= TRUSTED) / total, alpha * self.unigram(cw))


def _joined(answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    answers = sorted(answers, key=lambda x: x["bucket"])
    return np.concatenate([unpack(x["ids"]) for x in answers]), np.concatenate([unpack(x["counts"]) for x in answers]).astype(np.int64)


def _plain(model: Model, toks: np.ndarray, lens: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Known tokens and unigram score of each document."""
    starts = np.cumsum(lens) - lens
    base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
    return np.add.reduceat((count > 0)[toks].astype(np.int64), starts), np.add.reduceat(base[toks], starts)


def _bigrams(model: Model, toks: np.ndarray, lens: np.ndarray, gid: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """The place of each token's bigram among the block's distinct ones, and these by bucket, history and word: bucket, h, w, training counts of both."""
    start = len(gid)  # the history of first tokens
    key = np.empty(len(toks), np.int64)
    key[1:] = toks[:-1]
    key[np.cumsum(lens) - lens] = start
    key *= start + 1
    key += toks
    uniq, place = np.unique(key, return_inverse=True)
    del key
    hl, wl = uniq // (start + 1), uniq % (start + 1)
    h, w, ch, cw = np.r_[gid, np.uint64(0)][hl], gid[wl], np.r_[count, model.docs][hl], count[wl]
    bucket = model.bucket(h, w, ch)
    by = np.lexsort((w, h, bucket))
    moved = np.empty_like(by)
    moved[by] = np.arange(len(by))
    return moved[place], bucket[by], h[by], w[by], ch[by], cw[by]


def _changes(a: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin."""
    return np.flatnonzero(np.r_[True, a[1:] != a[:-1]])


def _send(sent) -> Callable:
    """Each block's distinct bigrams for each bucket: histories with their counts and numbers of words, then words, their counts and the bigrams' in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("block", pa.string()), ("arrays", pa.binary())])
        model = from_driver(sent)
        for batch in batches:
            for r in batch.to_pylist():
                gid, count = _joined(r["answers"])
                toks, lens, train = unpack(r["toks"]).astype(np.int32), unpack(r["lens"]).astype(np.int64), unpack(r["train"]).astype(bool)
                place, bucket, h, w, ch, cw = _bigrams(model, toks, lens, gid, count)
                trained = np.bincount(place[np.repeat(train, lens)], minlength=len(h))
                cw = np.where(trained > 0, cw, 0)  # only words that follow in training weigh
                cuts = np.r_[_changes(bucket), len(bucket)]
                rows = []
                for i, j in zip(cuts, cuts[1:]):
                    heads = _changes(h[i:j])
                    rows.append((int(bucket[i]), r["block"], bundle(h[i:j][heads], ch[i:j][heads], np.diff(np.r_[heads, j - i]) - 1, w[i:j], cw[i:j], trained[i:j])))
                yield from table(rows, schema)

    return run


def _short(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint32) if not len(a) or a.max() >> np.uint64(32) == 0 else a


def merged(asks: list[dict]) -> tuple[np.ndarray, ...]:
    """The bucket's distinct bigrams by history: h, training counts of the history, the word and the pair; where each asked bigram is among them; where each ask begins."""
    parts = [unbundle(x["arrays"]) for x in asks]
    sizes = [x[2].astype(np.int64) + 1 for x in parts]
    h, ch = (np.concatenate([np.repeat(_short(x[i]), n) for x, n in zip(parts, sizes)]) for i in range(2))
    w, cw, c = (np.concatenate([x[i] if i == 3 else _short(x[i]) for x in parts]) for i in range(3, 6))
    del parts
    h = h.astype(np.uint64)
    order = np.lexsort((w, h)) if max(h.max(), w.max()) >> np.uint64(32) else np.argsort((h << np.uint64(32)) | w)
    h, w = h[order], w[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])]
    heads = np.flatnonzero(new)
    back = np.empty(len(h), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    counted = np.add.reduceat(c[order].astype(np.int64), heads)
    return h[heads], ch[order[heads]].astype(np.int64), np.maximum.reduceat(cw[order], heads).astype(np.int64), counted, back, np.cumsum([0, *(n.sum() for n in sizes)])


def _reply(sent) -> Callable:
    """To each block the counts of its bigrams, in order; and the followers by count and their unigram sum of histories with
    an unseen word there, or without any follower that is discounted. Rows without a block: the bucket's counts of counts,
    and the same figures of its part of the spread histories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.string()), ("bucket", pa.int64()), ("arrays", pa.binary()), ("h", pa.int64()), ("small", pa.list_(pa.int64())), ("lower", pa.float64())])
        model = from_driver(sent)
        for batch in batches:
            for r in batch.to_pylist():
                h, ch, cw, c, back, starts = merged(r["asks"])
                heads = _changes(h)
                group = np.repeat(np.arange(len(heads), dtype=np.int32), np.diff(np.r_[heads, len(h)]))
                lower = np.add.reduceat(np.where(c > 0, model.unigram(cw), 0.0), heads)
                small = np.stack([np.add.reduceat((c == i).astype(np.int64), heads) for i in range(1, TRUSTED + 1)], 1)
                h, ch = h[heads], ch[heads]
                spread = model.pieces(ch) > 1
                rows: list[tuple] = [(None, r["bucket"], None, -1, np.bincount(np.minimum(c, TRUSTED + 2), minlength=TRUSTED + 3)[1 : TRUSTED + 2].tolist(), 0.0)]
                rows += [(None, r["bucket"], None, int(h[g]), [*small[g].tolist(), 0], float(lower[g])) for g in np.flatnonzero(spread).tolist()]
                whole = ~spread & (ch > 0) & ~small.any(1)
                for x, i, j in zip(r["asks"], starts, starts[1:]):
                    counts, own = c[back[i:j]], group[back[i:j]]
                    unseen = np.zeros(len(h), bool)
                    unseen[own[counts == 0]] = True
                    unseen &= ~spread & (ch > 0)
                    of = np.unique(own[unseen[own] | whole[own]])
                    rows.append((x["block"], r["bucket"], bundle(h[of], small[of].T.reshape(-1), np.where(unseen[of], lower[of], 0.0).view(np.uint64), counts), None, None, None))
                yield from table(rows, schema)

    return run


def _evaluate(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = from_driver(sent)
        for batch in batches:
            for r in batch.to_pylist():
                gid, count = _joined(r["answers"])
                toks, lens = unpack(r["toks"]).astype(np.int32), unpack(r["lens"]).astype(np.int64)
                known, base = _plain(model, toks, lens, count)
                place, _, h, _, ch, cw = _bigrams(model, toks, lens, gid, count)
                *histories, c = zip(*(unbundle(x["arrays"]) for x in sorted(r["replies"], key=lambda x: x["bucket"])))
                logp = np.log10(model.bigram(h, ch, cw, np.concatenate(c).astype(np.int64), *histories))
                yield pa.record_batch([
                    pa.array(np.frombuffer(zstandard.decompress(r["doc_ids"]), np.int64), mask=unpack(r["nulls"]).astype(bool)), pa.array(unpack(r["train"]) == 0), pa.array(lens), pa.array(known),
                    pa.array(np.full(len(lens), model.tokens)), pa.array(base), pa.array(np.add.reduceat(logp[place], np.cumsum(lens) - lens)),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, usable: Column, text: str = "text") -> DataFrame:
    """Learn from the rows for which `usable` holds and score every whole text.

    One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (additively smoothed unigrams),
    score. Both scores are log10 of the text's probability, its end included. P(w | h) is the discounted relative frequency
    of a seen bigram, else the history's backoff weight times P(w); P(w) is discounted alike, what is left goes to one
    unknown word, so every distribution sums to 1. Words are told apart by 64-bit hashes.

    Null is empty text: one end token. A null id counts as empty text for `usable`'s crc32. Repeated rows are repeated, in
    counts as well; other columns are ignored; without rows there is no result, without training rows every word is unknown.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small_batches(spark)
    # Bucketed by block, so that blocks stay where they are when the answers come.
    places = 2 ** max(4, (tasks - 1).bit_length())
    blocks = settle(docs.select("doc_id", filled(f"`{text}`").alias("body"), usable.alias("train")).mapInArrow(_blocks, BLOCKS), buckets=(places, "block"))
    bits = max(4, (max(tasks, blocks.count() // 4) - 1).bit_length())  # a bucket holds about as much as four blocks at most, at any size
    n = 2**bits
    asks = blocks.select("block", "hashes", "counts").mapInArrow(_ask(bits), "bucket long, block string, hashes binary, counts binary")
    words = settle(asks.groupBy("bucket").agg(F.collect_list(F.struct("block", "hashes", "counts")).alias("asks")).mapInArrow(_answer(n), "block string, bucket long, ids binary, counts binary, stats array<long>"))
    stats = words.filter("block IS NULL").select(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(TRUSTED + 4)]).first()
    model = Model(list(stats), n)

    # Dealt as the blocks are, answers cross the network once; no block holds so much that its list should be made in parts.
    answers = words.filter("block IS NOT NULL").repartition(places, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "ids", "counts")).alias("answers"))
    told = blocks.withColumnRenamed("ids", "doc_ids").join(answers, "block")
    sent = to_tasks(spark, model)
    bigrams = told.select("block", "lens", "train", "toks", "answers").mapInArrow(_send(sent), "bucket long, block string, arrays binary")
    replies = settle(bigrams.groupBy("bucket").agg(F.collect_list(F.struct("block", "arrays")).alias("asks")).mapInArrow(_reply(sent), "block string, bucket long, arrays binary, h long, small array<long>, lower double"))
    sums = (
        replies.filter("block IS NULL").groupBy("h").agg(*[F.sum(F.col("small")[i]).alias(f"n{i}") for i in range(TRUSTED + 1)], F.sum("lower").alias("lower")).orderBy("h")
    ).collect()  # at most four histories a bucket
    for r in sums[:1]:  # h = -1
        model.d2 = discounts([r[f"n{i}"] for i in range(TRUSTED + 1)])
    spread = sums[1:]
    model.spread = np.array([r["h"] for r in spread], np.uint64), np.array([[r[f"n{i}"] for i in range(TRUSTED)] for r in spread], np.int64).reshape(-1, TRUSTED), np.array([r["lower"] for r in spread], float)

    heard = replies.filter("block IS NOT NULL").select("block", "bucket", "arrays").repartition(places, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "arrays")).alias("replies"))
    return told.join(heard, "block").select("doc_ids", "nulls", "lens", "train", "toks", "answers", "replies").mapInArrow(
        _evaluate(to_tasks(spark, model)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
