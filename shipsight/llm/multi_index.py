"""Hard-negative mining with an inverted multi-index.

Each half of the vectors has a codebook; a pair of codewords is a cell. For an anchor, the score of a row is at most the
sum of two half bounds: anchor half times codeword plus the half's length times the codeword's radius. A heap over the two
sorted lists of half bounds visits cells from the highest sum on, and stops when a certificate holds: no unvisited cell can
reach the worst row that is still wanted. So results are exact, whatever sample the codebooks were fitted on.

Cells lie in blocks of bounded size (a large cell in several), written once. Anchors ask for the blocks of their cells and a
join brings both together; scores of a block come from one matrix product. Asking takes two rounds: a first few cells give
every anchor a floor under its worst wanted row, then all cells whose bound reaches the floor are visited.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shipsight.functions.settle import settle

from .text import from_driver, to_tasks

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Whole numbers up to here are exact as doubles.
EXACT = 1 << 53
#: Rounds of fitting a codebook.
FITTING = 8
#: Anchors whose scores against a block are held at once.
ANCHORS = 256


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Packed vectors as rows of whole numbers, shorter ones filled up with zeros."""
    raw = vectors.to_pylist()
    if all(len(v) == 8 * width for v in raw):
        return np.frombuffer(b"".join(raw), np.int64).reshape(len(raw), width)
    out = np.zeros((len(raw), width), np.int64)
    for row, v in zip(out, raw):
        row[: len(v) // 8] = np.frombuffer(v, np.int64)
    return out


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and x: exact as doubles where these hold them, else by Python's numbers, cut to 64 bits."""
    if a.size and x.size and a.shape[1] * float(np.abs(a.astype(float)).max()) * float(np.abs(x.astype(float)).max()) >= EXACT:
        return np.clip(a.astype(object) @ x.T.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)
    return a.astype(np.float64) @ x.T.astype(np.float64)


def nearest(x: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    return np.argmin((codebook**2).sum(1) - 2 * (x @ codebook.T), axis=1)


def fit(x: np.ndarray, codewords: int) -> np.ndarray:
    """A codebook by rounds of nearest codeword and mean, begun from evenly spaced rows; the same rows give the same one."""
    x = x[np.lexsort(x.T[::-1])] if len(x) else x
    codebook = x[np.linspace(0, len(x) - 1, codewords).astype(int)].copy()
    for _ in range(FITTING):
        place = nearest(x, codebook)
        counts = np.bincount(place, minlength=codewords)
        sums = np.zeros_like(codebook)
        np.add.at(sums, place, x)
        codebook = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], codebook)
    return codebook


class Index:
    """Both codebooks with the radius of each codeword, and of each cell the number of its rows and the blocks it lies in."""

    def __init__(self, width: int, books: tuple[np.ndarray, np.ndarray]):
        self.width, self.half, self.books = width, width // 2, books
        self.cells = len(books[0]) * len(books[1])

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each row and how far its halves lie from their codewords."""
        halves = x[:, : self.half], x[:, self.half :]
        at = [nearest(h, book) for h, book in zip(halves, self.books)]
        far = [np.sqrt(((h - book[i]) ** 2).sum(1)) for h, book, i in zip(halves, self.books, at)]
        return at[0] * len(self.books[1]) + at[1], *far

    def measured(self, cells: list[tuple[int, int, float, float]], block_rows: int) -> Index:
        """Take in (cell, rows, radius, radius) of all cells that have rows, and deal the cells to blocks in their order."""
        self.rows, self.first, self.parts = (np.zeros(self.cells, np.int64) for _ in range(3))
        self.radii = np.zeros(len(self.books[0])), np.zeros(len(self.books[1]))
        block, room = 0, block_rows
        for cell, n, r1, r2 in sorted(cells):
            i, j = divmod(cell, len(self.books[1]))
            self.radii[0][i], self.radii[1][j] = max(self.radii[0][i], r1), max(self.radii[1][j], r2)
            if n > room:
                block, room = block + (room < block_rows), block_rows
            parts = -(-n // block_rows)
            self.rows[cell], self.first[cell], self.parts[cell] = n, block, parts
            block, room = (block + parts, block_rows) if parts > 1 else (block, room - n)
        return self

    def visit(self, anchor: np.ndarray, floor: float, first: float) -> list[int]:
        """Cells by falling bound, until the bound is below `floor` or the visited cells hold `first` rows."""
        order, bounds = [], []
        for half, book, radii in zip((anchor[: self.half], anchor[self.half :]), self.books, self.radii):
            bound = book @ half + np.sqrt(half @ half) * radii
            bound += 1e-9 * np.abs(bound) + 1e-6  # whatever rounding took from it
            by = np.argsort(-bound, kind="stable")
            order.append(by.tolist())
            bounds.append(bound[by].tolist())
        (rows, columns), (u, v) = order, bounds
        width, out, held = len(columns), [], 0
        heap = [(-(u[0] + v[0]), 0, 0)]
        while heap and held < first:
            bound, p, q = heapq.heappop(heap)
            if -bound < floor:
                break
            cell = rows[p] * width + columns[q]
            if self.parts[cell]:
                out.append(cell)
                held += int(self.rows[cell])
            # Each pair enters once: down the first column, and to the right everywhere.
            if q == 0 and p + 1 < len(u):
                heapq.heappush(heap, (-(u[p + 1] + v[0]), p + 1, 0))
            if q + 1 < len(v):
                heapq.heappush(heap, (-(u[p] + v[q + 1]), p, q + 1))
        return out

    def blocks(self, cells: list[int]) -> list[int]:
        return sorted({b for c in cells for b in range(self.first[c], self.first[c] + self.parts[c])})


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    place = np.arange(len(score))
    if len(score) > k:
        place = np.flatnonzero(score >= np.partition(score, -k)[-k])
    return place[np.lexsort((ids[place], -score[place]))[:k]]


def prepared(vectors: DataFrame, anchor: Column, id: str, vector: str, label: str, scale: float) -> DataFrame:
    """Rows that take part, with whole components packed as 64-bit numbers."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = vectors.filter(F.col(id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(usable)
    return rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))


def indexed(rows: DataFrame, index: Index) -> DataFrame:
    """Rows with their cell, packed."""
    sent = to_tasks(rows.sparkSession, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = from_driver(sent)
        for batch in batches:
            packed = pa.array([np.array(v, np.int64).tobytes() for v in batch.column("v").to_pylist()], pa.binary())
            cell, far1, far2 = index.place(matrix(packed, index.width).astype(np.float64))
            columns = {"vec": packed, "cell": pa.array(cell, pa.int32()), "far1": pa.array(far1), "far2": pa.array(far2)}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "anchor")), *columns.values()], names=["id", "label", "anchor", *columns])

    return rows.mapInArrow(run, "id long, label long, anchor boolean, vec binary, cell int, far1 double, far2 double")


def blocked(rows: DataFrame, index: Index) -> DataFrame:
    """One row per block with its rows in an array; repeated rows count once."""
    # At most codewords x codewords rows, megabytes whatever the input.
    where = [(int(c), int(index.first[c]), int(index.parts[c])) for c in np.flatnonzero(index.parts)]
    dealt = rows.join(F.broadcast(rows.sparkSession.createDataFrame(where, "cell int, first int, parts int")), "cell")
    part = F.pmod(F.xxhash64("id", "label", "vec"), F.col("parts").cast("long")).cast("int")
    return dealt.groupBy((F.col("first") + part).alias("block")).agg(F.collect_set(F.struct("id", "label", "vec")).alias("rows"))


def asked(anchors: DataFrame, index: Index, first: float) -> DataFrame:
    """Anchors by the blocks that they visit: one row per block and batch of anchors. Anchors have a `floor`, null for none."""
    sent = to_tasks(anchors.sparkSession, index)
    schema = f"block int, anchors array<{anchors.schema.simpleString()}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = from_driver(sent)
        for batch in batches:
            by: dict[int, list[int]] = {}
            for i, (v, floor) in enumerate(zip(matrix(batch.column("vec"), index.width).astype(np.float64), batch.column("floor").to_pylist())):
                for b in index.blocks(index.visit(v, -math.inf if floor is None else floor, first)):
                    by.setdefault(b, []).append(i)
            rows = batch.to_struct_array()
            for b, places in by.items():
                lists = pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), rows.take(pa.array(places)))
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), lists], names=["block", "anchors"])

    return anchors.mapInArrow(run, schema)


def met(asks: DataFrame, blocks: DataFrame, width: int, choose: Callable, columns: str) -> DataFrame:
    """What `choose` finds for each anchor in each block that it asked for, as rows of `columns`."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                found = []
                rows, anchors = batch.column("rows")[n].values, batch.column("anchors")[n].values
                x, ids, labels = matrix(rows.field("vec"), width), rows.field("id").to_numpy(), rows.field("label").to_numpy()
                for at in range(0, len(anchors), ANCHORS):
                    some = pa.Table.from_struct_array(anchors.slice(at, ANCHORS))
                    a = matrix(some.column("vec").combine_chunks(), width)
                    for anchor, score in zip(some.drop_columns(["vec"]).to_pylist(), scores(a, x)):
                        found += choose(anchor, score, ids, labels)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=names)

    return asks.join(blocks, "block").select("rows", "anchors").mapInArrow(run, columns)


def ranked(hits: DataFrame, by: list[str], score: str, id: str, k: int) -> DataFrame:
    """The k best hits of each key, with their `rank`."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), id)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95),
    scale: float = 256.0, sample: int = 4096, cell_rows: int = 256, codewords: int = 256, block_rows: int = 8192, first: int = 4096,
) -> DataFrame:
    """For each row where `anchor` holds and each of its best same-label rows, the best other-label rows inside a score window.

    Components become floor(scale * x); a score is the inner product of such whole numbers, higher first, ties by smaller id.
    An anchor's positives are its first `positives` other rows of its label; for each, the first `negatives` rows of another
    label whose score is from window[0] to window[1] hundredths of the positive's, ends included, come back with their `rank`.

    `sample` rows, chosen by hash (twice as many at most), fit two codebooks of up to `codewords` words, so many that a cell
    has about `cell_rows` rows; the sample only decides which cells are visited, never a result. `first` is the number of rows
    that give an anchor its floor.

    Rows with a null id, label, vector or component, or one that isn't finite, take no part. Shorter vectors count as filled up
    with zeros; an empty one scores 0. Rows that repeat id, label and vector count once; rows that share only the id are rows of
    their own, but none is a positive of an anchor with its id. Scores are exact up to 64 bits and cut
    to them beyond. Fewer rows than asked for give fewer, an empty table none. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = prepared(vectors, anchor, id, vector, label, scale)
    total = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not total["n"]:
        return spark.createDataFrame([], RESULT)
    width, share = max(total["width"], 2), min(1.0, sample / total["n"])
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("v").limit(2 * sample).toArrow().column("v").to_pylist()
    chosen = matrix(pa.array([np.array(v, np.int64).tobytes() for v in chosen or [[0]]], pa.binary()), width).astype(np.float64)
    words = int(min(max(round(math.sqrt(total["n"] / cell_rows)), 1), codewords))
    index = Index(width, (fit(chosen[:, : width // 2], words), fit(chosen[:, width // 2 :], words)))

    placed = settle(indexed(rows, index))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far1").alias("r1"), F.max("far2").alias("r2"))  # codewords x codewords rows at most
    index = index.measured([tuple(r) for r in cells.collect()], block_rows)
    blocks = settle(blocked(placed, index))
    key = F.xxhash64("id", "label", "vec").alias("key")
    anchors = settle(placed.filter("anchor").select(key, "id", "label", "vec").dropDuplicates(["key"]))

    def same(anchor, score, ids, labels):
        keep = np.flatnonzero((labels == anchor["label"]) & (ids != anchor["id"]) & (score >= low(anchor["floor"])))
        return [(anchor["key"], int(score[i]), ids[i]) for i in keep[best(score[keep], ids[keep], positives)]]

    def other(anchor, score, ids, labels):
        keep = np.flatnonzero((labels != anchor["label"]) & (score >= low(anchor["floor"])))
        score, ids = score[keep], ids[keep]
        out = []
        for w in anchor["windows"]:
            inside = np.flatnonzero((score >= -(-window[0] * w["score"] // 100)) & (score <= window[1] * w["score"] // 100) & (score >= low(w["floor"])))
            out += [(anchor["key"], w["nth"], int(score[i]), ids[i]) for i in inside[best(score[inside], ids[inside], negatives)]]
        return out

    def rounds(anchors: DataFrame, choose: Callable, columns: str, by: list[str], k: int, floored: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Two rounds of visits: the best hits among the first cells give floors, then all cells that reach the floors are visited."""
        early = ranked(met(asked(anchors, index, first), blocks, width, choose, columns), by, "score", "hit", k)
        floors = settle(early.groupBy(*by).agg(F.when(F.count("*") >= k, F.min("score")).alias("least")))
        return ranked(met(asked(floored(floors), index, math.inf), blocks, width, choose, columns), by, "score", "hit", k)

    floor = (F.col("least") - F.abs("least") * 1e-12).alias("floor")  # under the score, also where a double is coarser
    found = rounds(
        anchors.withColumn("floor", F.lit(None).cast("double")), same, "key long, score long, hit long", ["key"], positives,
        lambda floors: anchors.join(floors.select("key", floor), "key", "left"),
    )
    found = settle(found.select("key", F.col("rank").cast("long").alias("nth"), "score", F.col("hit").alias("positive_id")))

    def with_windows(goals: DataFrame) -> DataFrame:
        """Anchors with the windows of their positives, `nth score floor`; their floor is the least of what any window needs."""
        lower = F.col("score") * (window[0] / 100.0)
        need = F.greatest(lower - F.abs(lower) * 1e-9 - 1.0, F.col("floor"))
        of = goals.groupBy("key").agg(F.collect_list(F.struct("nth", "score", "floor")).alias("windows"), F.min(need).alias("floor"))
        return anchors.join(of, "key").select("key", "id", "label", "vec", "windows", "floor")

    none = F.lit(None).cast("double").alias("floor")
    hits = rounds(
        with_windows(found.select("key", "nth", "score", none)), other, "key long, nth long, score long, hit long", ["key", "nth"], negatives,
        lambda floors: with_windows(found.join(floors, ["key", "nth"], "left").select("key", "nth", "score", floor)),
    )
    named = hits.select("key", "nth", "rank", F.col("hit").alias("negative_id"), F.col("score").alias("negative_score")).join(found.withColumnRenamed("score", "positive_score"), ["key", "nth"])
    return named.join(anchors.select("key", F.col("id").alias("anchor_id")), "key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def low(floor: float | None) -> float:
    return -math.inf if floor is None else floor
