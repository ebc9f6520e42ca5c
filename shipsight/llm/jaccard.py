"""Jaccard join of word shingles: candidate groups by shared prefixes, signature trees inside them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.settle import discard, settle
from .components import components, least_labels
from .katz import mixed, pack, table, unpack
from .text import filled, give_back, slices, small_batches
from .winnow import gram_hashes

#: Bits of a document's bitmap, and documents of a leaf.
BITS, LEAF = 512, 8


def set_of(words: list[bytes], numbers: dict[bytes, int], size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; of fewer words, the one of all of them."""
    ids = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
    return np.unique(gram_hashes(ids, min(size, len(words)))) if words else np.empty(0, np.uint64)


def sets(bodies: list[str], size: int) -> Iterator[np.ndarray]:
    runs = [b.encode("utf-8", "replace").lower().split() for b in bodies]
    numbers = {w: xxhash.xxh64_intdigest(w) for w in set().union(*runs)}
    return (set_of(r, numbers, size) for r in runs)


def key_of(s: np.ndarray) -> int:
    """A signed 64-bit key of a set; equal sets are one class from here on."""
    return int(np.frombuffer(xxhash.xxh64_digest(s.tobytes()), np.int64)[0])


def least_overlap(n, percent: int):
    return (percent * n + 99) // 100


def prefix_length(n, percent: int):
    """So many shingles of a set, the first in an order that all sets share: two sets that link have one of these in common."""
    return n - least_overlap(n, percent) + 1


#: Of each document: id, class key, size. Of the block's distinct sets, numbered as they come: shingles in order, and whose.
BLOCKS = "block string, ids binary, nulls binary, keys binary, sizes binary, hashes binary, owners binary, held long"


def _blocks(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.string()), *[(c, pa.binary()) for c in ("ids", "nulls", "keys", "sizes", "hashes", "owners")], ("held", pa.int64())])
        task = TaskContext.get()
        for no, part in enumerate(slices(batches, "body")):
            keys, sizes, own = [], [], {}
            for s in sets(part.column("body").to_pylist(), size):
                keys.append(key_of(s))
                sizes.append(len(s))
                if len(s):
                    own.setdefault(keys[-1], s)
            hashes = np.concatenate([np.empty(0, np.uint64), *own.values()])
            owners = np.repeat(np.arange(len(own)), [len(s) for s in own.values()])
            by = np.argsort(hashes, kind="stable")
            ids = part.column("doc_id")
            raw = np.array(ids.fill_null(0).to_pylist(), np.int64)
            yield from table([(f"{task.partitionId()}-{no}", zstandard.compress(raw.tobytes()), pack(np.array(ids.is_null().to_pylist())), np.array(keys, np.int64).tobytes(), pack(np.array(sizes)), pack(hashes[by], True), pack(owners[by]), len(hashes))], schema)

    return run


def classes(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """Keys and sizes of a block's distinct sets, as its owners number them."""
    keys, sizes = np.frombuffer(r["keys"], np.int64), unpack(r["sizes"]).astype(np.int64)
    some = np.flatnonzero(sizes)
    at = some[np.sort(np.unique(keys[some], return_index=True)[1])]
    return keys[at], sizes[at]


#: Shingles are counted by the first 48 of their 64 bits. A clash makes two look more common than they are, no more.
COUNTED = 48


def _short(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - COUNTED)


def _ask(bits: int) -> Callable:
    """A block's shingles and how many of its sets hold them, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("block", pa.string()), ("hashes", pa.binary()), ("counts", pa.binary())])
        give_back()
        for batch in batches:
            for r in batch.to_pylist():
                found, counts = np.unique(_short(unpack(r["hashes"])), return_counts=True)
                cuts = np.searchsorted((found >> np.uint64(COUNTED - bits)).astype(np.int64), np.arange(2**bits + 1))
                yield from table([(b, r["block"], pack(found[i:j], True), pack(counts[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j], schema)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each block, those of its shingles that more than one set holds, and how many do."""
    schema = pa.schema([("block", pa.string()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
    give_back()
    for batch in batches:
        for r in batch.to_pylist():
            asked = [unpack(x["hashes"]) for x in r["asks"]]
            found, back = np.unique(np.concatenate(asked), return_inverse=True)
            counts = np.bincount(back, np.concatenate([unpack(x["counts"]) for x in r["asks"]]).astype(float), len(found)).astype(np.int64)
            rows, at = [], 0
            for x, hashes in zip(r["asks"], asked):
                own = counts[back[at : at + len(hashes)]]
                at += len(hashes)
                if (own > 1).any():
                    rows.append((x["block"], r["bucket"], pack(hashes[own > 1], True), pack(own[own > 1])))
            yield from table(rows, schema)


def _spread(n_buckets: int, percent: int) -> Callable:
    """The shared shingles in the prefixes of a block's sets, by bucket. In the order of prefixes the shingles of one set
    only come first, then the rarer; those of one set only can meet nobody and stay at home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), *[(c, pa.binary()) for c in ("hashes", "at", "keys", "sizes")]])
        give_back()
        for batch in batches:
            for r in batch.to_pylist():
                keys, sizes = classes(r)
                hashes, owner = unpack(r["hashes"]), unpack(r["owners"]).astype(np.int64)
                answers = sorted(r["answers"], key=lambda x: x["bucket"])
                shared = np.concatenate([unpack(x["hashes"]) for x in answers])
                at = np.minimum(np.searchsorted(shared, _short(hashes)), len(shared) - 1)
                hit = shared[at] == _short(hashes)
                hashes, owner = hashes[hit], owner[hit]
                count = np.concatenate([unpack(x["counts"]) for x in answers])[at[hit]]
                held = np.bincount(owner, minlength=len(keys))
                room = prefix_length(sizes, percent) - (sizes - held)
                by = np.lexsort((hashes, count, owner))
                hashes, owner = hashes[by], owner[by]
                inside = np.arange(len(by)) - (np.cumsum(held) - held)[owner] < room[owner]
                hashes, owner = hashes[inside], owner[inside]
                bucket = (mixed(hashes) % np.uint64(n_buckets)).astype(np.int64)
                by = np.lexsort((hashes, bucket))
                hashes, owner = hashes[by], owner[by]
                cuts = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
                rows = []
                for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    if i < j:
                        own, at = np.unique(owner[i:j], return_inverse=True)
                        rows.append((b, pack(hashes[i:j], True), pack(at), keys[own].tobytes(), pack(sizes[own])))
                yield from table(rows, schema)

    return run


def _candidates(percent: int) -> Callable:
    """Edges between sets that share a prefix shingle: inside each shingle's list, ordered by size, neighbours whose sizes
    allow a link. Whoever could link in the list is connected by such neighbours; the bucket's edges become stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            for r in batch.to_pylist():
                hashes = np.concatenate([unpack(x["hashes"]) for x in r["parts"]])
                keys = np.concatenate([np.frombuffer(x["keys"], np.int64)[unpack(x["at"]).astype(np.int64)] for x in r["parts"]])
                sizes = np.concatenate([unpack(x["sizes"])[unpack(x["at"]).astype(np.int64)] for x in r["parts"]]).astype(np.int64)
                by = np.lexsort((keys, sizes, hashes))
                hashes, keys, sizes = hashes[by], keys[by], sizes[by]
                near = (hashes[1:] == hashes[:-1]) & (keys[1:] != keys[:-1]) & (100 * sizes[:-1] >= percent * sizes[1:])
                nodes, at = np.unique(np.concatenate([keys[:-1][near], keys[1:][near]]), return_inverse=True)
                half = int(near.sum())
                root = least_labels(len(nodes), at[:half], at[half:])
                other = np.flatnonzero(root != np.arange(len(nodes)))
                yield pa.record_batch([pa.array(nodes[other]), pa.array(nodes[root[other]])], schema=schema)

    return run


class Group:
    """Some sets, each with the label of its component so far; `link` joins the labels of all that link."""

    def __init__(self, members: list[np.ndarray], labels: np.ndarray, percent: int):
        self.percent, self.n = percent, np.array([len(s) for s in members])
        _, flat = np.unique(np.concatenate(members), return_inverse=True)
        self.starts = np.r_[0, np.cumsum(self.n)]
        self.tokens = flat
        self.holders = np.repeat(np.arange(len(members), dtype=np.int32), self.n)[np.argsort(flat, kind="stable")]
        self.offsets = np.r_[0, np.cumsum(np.bincount(flat))]
        self.label = np.unique(labels, return_inverse=True)[1]

    def overlaps(self, a: int) -> np.ndarray:
        """Sizes of the intersections of one set with all."""
        t = self.tokens[self.starts[a] : self.starts[a + 1]]
        t = t[self.offsets[t + 1] - self.offsets[t] > 1]
        held = [self.holders[i:j] for i, j in zip(self.offsets[t].tolist(), self.offsets[t + 1].tolist())]
        both = np.bincount(np.concatenate(held), minlength=len(self.n)) if held else np.zeros(len(self.n), np.int64)
        both[a] = self.n[a]
        return both

    def linked(self, a: int) -> np.ndarray:
        both = self.overlaps(a)
        return 100 * both >= self.percent * (self.n + self.n[a] - both)

    def unite(self, rows: np.ndarray) -> None:
        """The labels of these rows become one."""
        old = np.unique(self.label[rows])
        if len(old) > 1:
            self.label[np.isin(self.label, old)] = old[0]

    def link(self) -> np.ndarray:
        if len(np.unique(self.label)) > 1:
            self.traverse()
        return self.label

    def traverse(self) -> None:
        """Dual traversal of the signature tree for links between different labels.

        Rows are ordered by label and size and cut into leaves; a node has the union and the intersection of its bitmaps, its
        size range, and its label if it has one. A bit of a set that is missing in the other's union stands for at least one
        shingle outside the intersection, which bounds the overlap from above; the size range bounds what is needed. Pairs of
        rows that the tree leaves are compared in full, unless links found before have joined them.
        """
        order = np.lexsort((self.n, self.label))
        bits = (self.tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(BITS)
        maps = np.zeros((len(self.n), BITS), bool)
        maps[np.repeat(np.arange(len(self.n)), self.n), bits.astype(np.int64)] = True
        maps = np.packbits(maps, axis=1).view(np.uint64)[order]
        n, label = self.n[order], self.label[order]
        levels = [(maps, maps, n, n, label)]
        width = LEAF
        while len(levels[-1][2]) > 1:
            any_, all_, low, high, lab = levels[-1]
            at = np.arange(0, len(low), width)
            pure = np.minimum.reduceat(lab, at) == np.maximum.reduceat(lab, at)
            levels.append((np.bitwise_or.reduceat(any_, at), np.bitwise_and.reduceat(all_, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.where(pure, lab[at], -1)))
        top = len(levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        done = np.zeros(len(n), bool)
        while stack:
            depth, i, j = stack.pop()
            if len(i) > 200_000:  # the rest waits, so the pairs at hand stay bounded
                stack.append((depth, i[200_000:], j[200_000:]))
                i, j = i[:200_000], j[:200_000]
            i, j = self.possible(levels[depth], i, j)
            if not len(i):
                continue
            if depth:
                size = len(levels[depth - 1][2])
                a = (i[:, None] * width + np.arange(width)).repeat(width, axis=1).ravel()
                b = np.tile(j[:, None] * width + np.arange(width), width).ravel()
                ok = (a < size) & (b < size) & ((i != j).repeat(width * width) | (a <= b))
                stack.append((depth - 1, a[ok], b[ok]))
                continue
            by = np.argsort(i, kind="stable")
            own, at = np.unique(i[by], return_index=True)
            for x, others in zip(own.tolist(), np.split(j[by], at[1:])):
                if not done[x] and (self.label[order[others[~done[others]]]] != self.label[order[x]]).any():
                    hit = np.flatnonzero(self.linked(order[x]))
                    self.unite(np.r_[order[x], hit])
                    done[x] = True

    def possible(self, level: tuple, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        any_, all_, low, high, lab = level
        ok = (lab[i] != lab[j]) | (lab[i] < 0)
        ok &= (100 * high[i] >= self.percent * low[j]) & (100 * high[j] >= self.percent * low[i])
        i, j = i[ok], j[ok]
        most = np.minimum(high[i] - np.bitwise_count(all_[i] & ~any_[j]).sum(axis=1), high[j] - np.bitwise_count(all_[j] & ~any_[i]).sum(axis=1))
        ok = (100 + self.percent) * most >= self.percent * (low[i] + low[j])
        return i[ok], j[ok]


#: What is carried of a class beside its set: candidate group, its size, its number of parts, and the class's part.
CHOSEN = ("key", "root", "m", "parts", "part")


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*[(c, pa.int64()) for c in CHOSEN], ("shingles", pa.binary())])
    give_back()
    for batch in batches:
        for r in batch.to_pylist():
            keys, sizes = classes(r)
            hashes = unpack(r["hashes"])[np.argsort(unpack(r["owners"]), kind="stable")]
            ends = dict(zip(keys.tolist(), np.cumsum(sizes).tolist()))
            starts = dict(zip(keys.tolist(), (np.cumsum(sizes) - sizes).tolist()))
            yield from table([(*[w[c] for c in CHOSEN], pack(hashes[starts[w["key"]] : ends[w["key"]]], True)) for w in r["wanted"]], schema)


def _link(percent: int) -> Callable:
    def run(key, group):
        rows = group.to_pylist()
        by: dict[tuple, list[dict]] = {}
        for r in rows:
            by.setdefault((r["root"], r["part"]), []).append(r)
        out: list[tuple[int, int]] = []
        for some in by.values():
            some = list({r["key"]: r for r in some}.values())
            if len(some) > 1:
                some.sort(key=lambda r: r["key"])
                labels = Group([unpack(r["shingles"]) for r in some], np.array([r["label"] for r in some]), percent).link()
                first = {}
                for r, lab in zip(some, labels.tolist()):
                    out.append((r["key"], first.setdefault(lab, r["key"])))
        out = [(a, b) for a, b in out if a != b]
        return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            raw = np.frombuffer(zstandard.decompress(r["ids"]), np.int64)
            ids = pa.array(raw, mask=unpack(r["nulls"]).astype(bool))
            yield pa.record_batch([pa.array([r["block"]] * len(raw), pa.string()), ids, pa.array(np.frombuffer(r["keys"], np.int64)), pa.array(unpack(r["sizes"]).astype(np.int64))], names=["block", "doc_id", "key", "n"])


def link_groups(docs: DataFrame, percent: int = 75, size: int = 5, text: str = "text", group: int = 3000, pilots: int = 24, bucket: int = 1_500_000) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked by shingle sets whose Jaccard similarity is percent / 100 or more.

    1. Texts become blocks of shingle sets, written once; equal sets are one class (by a 64-bit key). Hash buckets count
       every shingle over all blocks and tell each block which of its shingles others hold too, and how many.
    2. Of each class, the prefix of its set, in an order that puts common shingles last, goes to hash buckets; whatever
       could link shares a prefix shingle, and the buckets' edges give candidate groups (components of a graph of could-be
       links). Sets with enough shingles of their own need not be sent at all.
       One set of each class in a candidate group goes to its group's task. There a signature tree with dual traversal
       finds every link between sets that are not joined yet.
    3. A group of more than `group` classes is cut into parts that share `pilots` members, through which parts of one
       family join. Groups that are still in several components afterwards get a second pass over pairs of parts, which
       compares only sets of different components. So a large family of near copies costs one pass, no task holds more
       than two parts, and no link is lost.

    Null texts and texts without words have an empty set and are their own component, as are null ids among them. Repeated
    rows are copies; ties of ids are harmless; other columns are ignored; no rows give none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", filled(f"`{text}`").alias("body"))
    n_buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Bucketed by block, so that blocks stay where they are when answers come.
    blocks = settle(rows.mapInArrow(_blocks(size), BLOCKS), buckets=(n_buckets, "block"))
    bits = ((blocks.agg(F.sum("held")).first()[0] or 0) // bucket).bit_length()
    asks = blocks.select("block", "hashes").mapInArrow(_ask(bits), "bucket long, block string, hashes binary, counts binary")
    told = asks.groupBy("bucket").agg(F.collect_list(F.struct("block", "hashes", "counts")).alias("asks")).mapInArrow(_answer, "block string, bucket long, hashes binary, counts binary")
    # Few buckets are written by few tasks, whatever the number of partitions.
    told = told.coalesce(max(spark.sparkContext.defaultParallelism, 4 << bits))
    answers = settle(told).groupBy("block").agg(F.collect_list(F.struct("bucket", "hashes", "counts")).alias("answers"))

    sent = blocks.select("block", "keys", "sizes", "hashes", "owners").join(answers, "block").mapInArrow(_spread(n_buckets, percent), "bucket long, hashes binary, at binary, keys binary, sizes binary")
    could = sent.groupBy("bucket").agg(F.collect_list(F.struct("hashes", "at", "keys", "sizes")).alias("parts")).mapInArrow(_candidates(percent), "a long, b long")
    groups = components(could).withColumnRenamed("node", "key")
    each = settle(blocks.select("block", "ids", "nulls", "keys", "sizes")).mapInArrow(_each, "block string, doc_id long, key long, n long")
    sizes = groups.groupBy("root").agg(F.count("*").alias("m"))
    chosen = each.join(groups, "key").groupBy("key").agg(F.min("block").alias("block"), F.min("root").alias("root")).join(sizes, "root")
    chosen = chosen.withColumn("parts", F.ceil(F.col("m") / group).cast("long")).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    wanted = chosen.groupBy("block").agg(F.collect_list(F.struct(*CHOSEN)).alias("wanted"))
    looked = blocks.select("block", "keys", "sizes", "hashes", "owners").join(wanted, "block")
    members = looked.mapInArrow(_sets_of, ", ".join(f"{c} long" for c in CHOSEN) + ", shingles binary")

    written = settle(members)
    discard(blocks)
    dealt = written.withColumn("label", F.col("key"))
    # Small groups share tasks; each still counts alone.
    lots = F.when(F.col("parts") > 1, F.xxhash64("root", "part")).otherwise(F.pmod(F.xxhash64("root"), F.lit(64 * n_buckets)))
    every = F.pmod(F.xxhash64(F.col("key") + 1), F.greatest(F.floor(F.col("m") / pilots), F.lit(1))) == 0
    copies = dealt.filter((F.col("parts") > 1) & every).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    first = dealt.unionAll(copies.select(dealt.columns)).withColumn("lot", lots).groupBy("lot").applyInArrow(_link(percent), "a long, b long")
    edges = settle(first)
    found = components(edges)

    # Labels alone tell which groups are open; only their sets are read again.
    named = written.filter("parts > 1").select("key", "root", "part").distinct().join(found.select(F.col("node").alias("key"), F.col("root").alias("label")), "key", "left")
    labels = settle(named.withColumn("label", F.coalesce("label", "key")))
    open_groups = settle(labels.groupBy("root").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("root"))
    if open_groups.limit(1).count():
        left = settle(written.join(open_groups, "root").select("key", "root", "part", "shingles").join(labels.select("key", "label"), "key"))
        pure = left.groupBy("root", "part").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        a, b = pure.alias("a"), pure.alias("b")
        pairs = a.join(b, (F.col("a.root") == F.col("b.root")) & (F.col("a.part") < F.col("b.part"))).filter("NOT (a.lo = a.hi AND b.lo = b.hi AND a.lo = b.lo)")
        pairs = pairs.select(F.col("a.root").alias("root"), F.col("a.part").alias("p"), F.col("b.part").alias("q"))
        twice = pairs.select("root", F.col("p").alias("part"), "p", "q").unionAll(pairs.select("root", F.col("q").alias("part"), "p", "q"))
        second = left.join(twice, ["root", "part"]).withColumn("part", F.xxhash64("p", "q")).select("key", "root", "part", "label", "shingles").withColumn("lot", F.xxhash64("root", "part"))
        found = components(edges.unionAll(second.groupBy("lot").applyInArrow(_link(percent), "a long, b long")))
    discard(written)

    named = each.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    heads = named.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return named.join(heads, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
