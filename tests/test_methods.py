"""Frontiers, rank correlation, polynomial fits and the choice of a table against brute force."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shipsight.operators import evaluate, forecast
from shipsight.sources import io


@pytest.mark.parametrize("values", [6, 1000])
def test_frontier_equals_all_pairs(spark, values):
    rng = random.Random(values)
    rows = [(i, *(float(rng.randrange(values)) for _ in range(3))) for i in range(400)] + [(1000, None, 1.0, 1.0), (1001, 2.0, 2.0, 2.0), (1002, 2.0, 2.0, 2.0)]
    rows += [(2000 + i, float(i), float(values - i), 0.5) for i in range(40)]  # a chain of rows that none beats
    got = {r.k for r in evaluate.pareto_frontier(spark.createDataFrame(rows, "k int, a double, b double, c double").repartition(6), ["a", "b", "c"], ["k"]).collect()}
    full = [r for r in rows if None not in r]
    beats = lambda x, y: all(p >= q for p, q in zip(x[1:], y[1:])) and x[1:] != y[1:]
    assert got == {y[0] for y in full if not any(beats(x, y) for x in full)}
    assert evaluate.pareto_frontier(spark.createDataFrame([], "k int, a double"), ["a"], ["k"]).count() == 0


def test_rank_correlation_equals_average_ranks(spark):
    rng = random.Random(8)
    rows = [(i % 3, float(rng.randrange(12)), rng.choice([None, float(rng.randrange(9))])) for i in range(150)] + [(7, 1.0, 2.0)] * 6 + [(8, 1.0, 2.0), (8, 2.0, 3.0)]
    got = {r.k: r.rho for r in evaluate.rank_correlation(spark.createDataFrame(rows, "k int, a double, b double"), ["k"], "a", "b").collect()}

    def ranks(x):
        x = np.array(x)
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    for k in range(3):
        a, b = zip(*[(x, y) for key, x, y in rows if key == k and y is not None])
        assert got[k] == pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1])
    assert got[7] is None and got[8] is None


@pytest.mark.parametrize("degree", [2, 3])
def test_polynomials_equal_a_least_squares_fit(spark, degree):
    rng = random.Random(degree)
    rows = [(n, [rng.uniform(0, 100) for _ in range(n)]) for n in range(1, 13)]
    df = spark.createDataFrame(rows, "n int, v array<double>").select("n", forecast.polynomial(F.col("v"), degree, 8).alias("p"))
    got = {r.n: r.p for r in df.collect()}
    for n, v in rows:
        t = v[-8:]
        want = np.polyval(np.polyfit(np.arange(len(t)), t, degree), len(t)) if len(t) >= degree + 2 else None
        assert got[n] == (pytest.approx(want, rel=1e-6) if want is not None else None)


def test_there_are_29_extended_methods(spark):
    df = spark.createDataFrame([([5.0, 0.0, 3.0, 8.0, 9.0, 4.0, 7.0, 6.0, 3.0, 9.0, 2.0, 8.0],), ([1.0],), ([0.0] * 12,)], "v array<double>")
    methods = forecast.extended_methods(F.col("v"))
    assert len(methods) == 29
    for row in df.select(*[e.alias(k) for k, e in methods.items()]).collect():
        assert all(x is not None and x >= 0 for x in row)
    v = [5.0, 0.0, 3.0, 8.0, 9.0, 4.0, 7.0, 6.0, 3.0, 9.0, 2.0, 8.0]
    first = df.select(*[e.alias(k) for k, e in methods.items()]).first()
    assert first["seasonal_naive_4"] == 3.0 and first["drift_4"] == pytest.approx(8 + (8 - 3) / 3)
    assert first["differenced_mean_4"] == pytest.approx(8 + (8 - 6) / 4) and first["exponential_mean_4"] == pytest.approx(np.dot(v[-4:], np.exp(range(4))) / np.exp(range(4)).sum())


def test_the_newer_of_two_tables_is_read(spark, tmp_path):
    schema = "k long, name string"
    old, new = (spark.createDataFrame([(1, x)], schema) for x in ("csv", "parquet"))
    path = f"{tmp_path}/silver.csv"
    old.coalesce(1).write.option("header", True).csv(path)
    assert [r.name for r in io.newest_silver(spark, path, old.schema).collect()] == ["csv"]  # no parquet beside it
    new.coalesce(1).write.parquet(f"{tmp_path}/silver.parquet")
    assert [r.name for r in io.newest_silver(spark, path, old.schema).collect()] == ["parquet"]
    for folder, _, files in os.walk(path):
        for f in files:
            os.utime(f"{folder}/{f}", (time.time() + 100,) * 2)
    assert [r.name for r in io.newest_silver(spark, path, old.schema).collect()] == ["csv"]


def test_reconciliation_equals_a_dense_solve(spark):
    rng = random.Random(6)
    leaves = [(f"a{i % 3}", f"b{i % 3}{i % 2}", i) for i in range(17)]
    mids, tops = sorted({x[:2] for x in leaves}), sorted({x[0] for x in leaves})
    node = lambda: (rng.uniform(-5, 50), rng.uniform(0.1, 9))
    values = {0: {x: node() for x in leaves}, 1: {x: node() for x in mids}, 2: {(x,): node() for x in tops}, 3: {(): node()}}
    keys = [["a", "b", "c"], ["a", "b"], ["a"], []]
    kinds = {"a": "string", "b": "string", "c": "int"}
    frames = [(k, spark.createDataFrame([(*x, *v) for x, v in values[i].items()], ", ".join([*[f"{c} {kinds[c]}" for c in k], "forecast double, variance double"]))) for i, k in enumerate(keys)]
    got = {(r.level, *(x for x in (r.a, r.b, r.c) if x is not None)): r.reconciled for r in forecast.least_squares_tree(frames).collect()}
    nodes = [(i, x) for i in range(4) for x in values[i]]
    summing = np.array([[float(leaf[: len(x)] == x) for leaf in leaves] for _, x in nodes])
    y, w = np.array([values[i][x][0] for i, x in nodes]), np.array([1 / values[i][x][1] for i, x in nodes])
    want = summing @ np.linalg.solve(summing.T @ (summing * w[:, None]), summing.T @ (w * y))
    assert len(got) == len(nodes)
    for (i, x), z in zip(nodes, want):
        assert got[(i, *x)] == pytest.approx(z)
