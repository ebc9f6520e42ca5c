"""The portrait at many cut-offs over series of arrays, against the operators that repeat the months for each cut-off."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shipsight.functions import series
from shipsight.operators import product

CUTS = [30, 33, 40, 41]


def months(spark):
    """Products of few and many months, with missing figures, returns and a category that changes."""
    rnd, rows = random.Random(5), []
    for p in [*range(40), None]:
        for m in sorted(rnd.sample(range(1, 44), rnd.choice([1, 2, 5, 12, 25, 40]))):
            qty = None if rnd.random() < 0.05 else float(rnd.choice([-3, 0, 5, 20, 900, 7000]))
            rev = float(rnd.choice([0, 120, 450.25, 9000]))
            rows.append((p, m, qty, rev, None if rnd.random() < 0.05 else rev * rnd.choice([-0.2, 0.1, 0.25, 1 / 3]), Decimal(rnd.choice([5, 7000])), rnd.choice([True, False, False, None]), f"c{(p or 0) % 3}" if (p or 0) % 4 else rnd.choice(["c0", "c1", None]), "line"))
    kinds = "product_id bigint, month_idx int, qty double, rev_pos double, profit double, max_row_qty decimal(18,4), is_new boolean, category string, product_line string"
    return spark.createDataFrame(rows, kinds).withColumn("avg_price", F.col("rev_pos") / F.nullif(F.col("qty"), F.lit(0.0)))


def customers(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([*range(40), None]), rnd.choice([1, 2, 3, 4, 5, None]), rnd.randrange(1, 44), rnd.choice([None, Decimal("-10.1"), Decimal("10.1"), Decimal("333.3333")])) for _ in range(900)]
    one = spark.createDataFrame(rows, "product_id bigint, customer_id bigint, month_idx int, revenue decimal(18,4)")
    return one.groupBy("product_id", "customer_id", "month_idx").agg(F.sum("revenue").alias("revenue"))


def near(x):
    return round(x, 7) + 0.0 if isinstance(x, float) else x


def rows_of(df, columns):
    return {(r["product_id"], r["as_of"]): tuple(near(r[c]) for c in columns) for r in df.collect()}


def test_all_figures_equal_those_of_the_operators(spark):
    pm, cpm = months(spark), customers(spark)
    got = product.profile(pm, cpm, CUTS)
    rows = product.at_cutoffs(pm, CUTS)
    info = product.product_info(rows).filter("age >= 3")
    keys = rows_of(got, [])
    for part in (info, product.window_aggregates(rows), product.reference_margin(rows, info), product.profit_slope(rows), product.order_volatility(rows), product.decline_streak(rows), product.asp_slope(rows), product.concentration(cpm, CUTS)):
        names = [c for c in part.columns if c not in product.KEYS]
        want = {k: v for k, v in rows_of(part, names).items() if k in keys}
        have = rows_of(got, names)
        assert want and all(have[k] == v for k, v in want.items()), names
    assert set(rows_of(info, [])) - {(None, t) for t in CUTS} == set(keys)


@pytest.mark.parametrize("size", ["1", "7"])
def test_customers_of_a_product_may_span_batches(spark, size):
    """Sums of a product are put together again, however its rows are cut into batches."""
    cpm = customers(spark)
    want = {k: v for k, v in rows_of(product.concentration(cpm, CUTS), ["top1", "top3"]).items() if k[0] is not None}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = {r["product_id"]: r for r in series.customer_shares(cpm, CUTS).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for (p, t), shares in want.items():
        assert (near(got[p]["top1"][CUTS.index(t)]), near(got[p]["top3"][CUTS.index(t)])) == shares


def test_months_are_not_repeated_for_each_cutoff(spark):
    """Neither months nor customers are dealt again with a cut-off: the portrait's plan has no generator over them."""
    plan = product.profile(months(spark), customers(spark), CUTS)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
