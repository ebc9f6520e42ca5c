"""Connected components, in a task and across the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.settle import discard, settle


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each of n nodes' components, by hooking and pointer jumping over whole arrays."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label != label[label]).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


#: Edges that a task joins at once.
EDGES = 500_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges u, v as stars: of each component of so many edges at once, its other nodes with the least one."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def joined(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        edges = pa.Table.from_batches(kept)
        nodes, at = np.unique(np.concatenate([edges["u"].to_numpy(), edges["v"].to_numpy()]), return_inverse=True)
        root = least_labels(len(nodes), at[: len(edges)], at[len(edges) :])
        other = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.record_batch([pa.array(nodes[other]), pa.array(nodes[root[other]])], schema=schema)

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) >= EDGES:
            yield joined(kept)
            kept = []
    if kept:
        yield joined(kept)


def _open(edges: DataFrame, tasks: int) -> bool:
    """Whether some node has two lesser neighbours, or lesser and greater ones, so that the edges are no stars yet."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("up")).unionAll(edges.select("v", F.lit(None).cast("long")))
    nodes = ends.groupBy("node").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.max(F.col("up").isNull()).alias("head"))
    return nodes.filter("low <> high OR low IS NOT NULL AND head").coalesce(tasks).count() > 0


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's least node) for every node of the edges a, b (long).

    Alternating large and small stars: every node tells its greater neighbours, then its lesser ones, the least node it
    knows. Before and between them each task turns the edges that it holds into stars, which drops repeated edges and
    shortens paths without a shuffle. Each step is written to the shared folder, so the lineage stays short, by as many
    tasks as the edges need; minima are combined before shuffles. The steps end when all edges are stars.
    """
    raw = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"))
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-raw.count() // EDGES))

    def stars(some: DataFrame) -> DataFrame:
        return settle(some.coalesce(tasks).mapInArrow(_stars, "u long, v long"))

    now = stars(raw)
    discard(raw)
    while _open(now, tasks):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = stars(both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select("v", "m").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, stars(small.unionAll(low.select("u", F.col("m").alias("v"))))
        discard(old)
        discard(large)
    out = settle(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select("v", "v")).distinct().coalesce(tasks))
    discard(now)
    return out
