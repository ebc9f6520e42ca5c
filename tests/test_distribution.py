"""Exact order statistics: the split path must equal brute force, whatever the skew."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shipsight.functions import distribution as dist

SPLIT = {"ranges": 8}


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    # One key holds over a third of the rows, and one value a third of that key.
    key = np.where(rng.random(6000) < 0.4, 0, rng.integers(1, 40, 6000))
    val = np.round(rng.normal(100, 30, 6000), 2)
    val[(key == 0) & (rng.random(6000) < 0.33)] = 50.0
    pdf = pd.DataFrame({"k": key.astype(int), "v": val, "id": np.arange(6000)})
    return pdf, spark.createDataFrame(pdf).repartition(7)


@pytest.mark.parametrize("kw", [{}, SPLIT])
def test_quantiles(skewed, kw):
    pdf, df = skewed
    got = dist.quantiles(df, ["k"], "v", {"a": 0.15, "b": 0.5, "c": 0.97}, count_as="n", **kw).toPandas().set_index("k").sort_index()
    exp = pdf.groupby("k")["v"].quantile([0.15, 0.5, 0.97]).unstack()
    assert np.allclose(got[["a", "b", "c"]].to_numpy(), exp.to_numpy())
    assert (got["n"] == pdf.groupby("k").size()).all()


@pytest.mark.parametrize("kw", [{}, SPLIT])
def test_running_sum_per_key(skewed, kw):
    pdf, df = skewed
    got = dist.running(df, ["k"], ["v", "id"], {"n": F.lit(1)}, **kw).toPandas()
    pdf = pdf.sort_values(["k", "v", "id"])
    pdf["exp"] = pdf.groupby("k").cumcount()
    m = got.merge(pdf[["id", "exp"]], on="id")
    assert (m["n_before"] == m["exp"]).all() and len(m) == len(pdf)


@pytest.mark.parametrize("kw", [{}, SPLIT])
def test_pct_rank_matches_average_rank(skewed, kw):
    pdf, df = skewed
    got = dist.pct_rank(df, [], "v", "p", **kw).toPandas().set_index("id").sort_index()["p"]
    assert np.allclose(got, pdf["v"].rank(pct=True))


@pytest.mark.parametrize("kw", [{}, SPLIT])
def test_equal_depth_matches_qcut(skewed, kw):
    pdf, df = skewed
    got = dist.equal_depth(df, [], "v", "s", **kw).toPandas().set_index("id").sort_index()["s"]
    exp = pd.qcut(pdf["v"].rank(method="dense"), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert (got == exp).all()


def test_equal_depth_collapses_to_middle(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(9)] + [(9, 2.0), (10, None)], "id int, v double")
    assert {r["s"] for r in dist.equal_depth(df, [], "v", "s", dense=False).collect()} == {3}


def test_split_path_uses_many_partitions(skewed):
    _, df = skewed
    r = dist.running(df, ["k"], ["v", "id"], {"n": F.lit(1)}, **SPLIT)
    assert "cartesian" not in r._jdf.queryExecution().toString().lower()
