"""Hard negatives of the inverted multi-index against brute force."""

import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shipsight.llm import multi_index
from tests.llm.test_operators import SF
from tools.check import norm

COLUMNS = "vec_id long, embedding array<double>, label int, cell int, block string, score double"


def brute(rows, anchor, positives=5, negatives=3, window=(50, 95), scale=256):
    usable = [(i, tuple(math.floor(scale * x) for x in v), y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    usable = sorted(set(usable))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, y in usable:
        if not anchor(i):
            continue
        scored = sorted((-score(v, w), j, z) for j, w, z in usable)
        for p, j, z in [s for s in scored if s[2] == y and s[1] != i][:positives]:
            fit = [(n, k) for n, k, other in scored if other != y and window[0] * -p <= 100 * -n <= window[1] * -p][:negatives]
            out += [(i, j, r, k, -p, -n) for r, (n, k) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, y, 1, "b", 0.5) for i, v, y in rows], COLUMNS).repartition(4)
    found = multi_index.mine(frame, F.col("vec_id") % 5 == 0, **more)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(rng, n, width, labels=4):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(7)]
    return [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = vectors(rng, 400, 6)
    rows += [(1001, None, 1), (1002, [1.0] * 6, None), (1003, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1005, [math.nan] * 6, 1), (1010, [math.inf] * 6, 1), (None, [1.0] * 6, 1)]
    rows += [rows[5], rows[5], (5, rows[5][1], 3), (10, [9.0] * 6, 0)]  # repeated rows, an id with several rows
    rows += [(2000 + i, rows[20][1], i % 2) for i in range(60)]  # equal vectors: ties by id
    rows += [(3000, [], 1), (3005, [0.5], 1), (3010, [0.1] * 9, 2)]  # vectors of other lengths
    want = brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 300
    assert mined(spark, rows) == want
    assert mined(spark, rows, cell_rows=4, block_rows=25, first=20, sample=50) == want


def test_bounded_cells_and_blocks(spark):
    rows = [(i, [1.0, 2.0], i % 2) for i in range(500)]  # one cell with all rows, cut into blocks
    assert mined(spark, rows, block_rows=60, window=(50, 100)) == brute(rows, lambda i: i % 5 == 0, window=(50, 100))


def test_large_numbers_and_empty_tables(spark):
    rows = [(i, [float(2**19 + 3 * i), float(i)], i % 2) for i in range(12)]
    assert mined(spark, rows, window=(50, 100)) == brute(rows, lambda i: i % 5 == 0, window=(50, 100))
    assert mined(spark, []) == [] == mined(spark, [(5, None, 1)])
    assert mined(spark, [(5, [1.0], 1)]) == []


def test_heap_visits_by_falling_bounds_that_hold():
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(12, 8))[rng.integers(12, size=600)] + 0.1 * rng.normal(size=(600, 8))))
    index = multi_index.Index(8, (multi_index.fit(x[:200, :4], 5), multi_index.fit(x[:200, 4:], 5)))
    cell, far1, far2 = index.place(x)
    rows = [(int(c), int((cell == c).sum()), float(far1[cell == c].max()), float(far2[cell == c].max())) for c in np.unique(cell)]
    index.measured(rows, 100)
    assert sorted(index.visit(x[0], -math.inf, math.inf)) == [r[0] for r in rows]
    assert index.rows[index.visit(x[0], -math.inf, 100)].sum() >= 100
    for floor in np.quantile(x @ x[0], [0.2, 0.8, 0.99]):
        visited = index.visit(x[0], floor, math.inf)
        assert set(cell[x @ x[0] >= floor]) <= set(visited)
    assert len(visited) < len(rows)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = entry.queries()["op12_hard_negatives"](spark, SF).toPandas()
    assert norm(got) == norm(con.sql(entry.oracle_sql()["op12_hard_negatives"]).df())
