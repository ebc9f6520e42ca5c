"""Monthly trends of customers, category migration and the window studies of declining products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import cases, count_if, dbl, div, top_k
from .period import at_lag


def revenue_trend(cm: DataFrame, key: str = "customer_id", min_history: int = 3, up: float = 0.02, down: float = -0.02, cap: float = 999.0) -> DataFrame:
    """MA3, MA6, month-on-month (previous observed row), year-on-year (calendar), 6-row OLS slope and direction."""
    w = Window.partitionBy(key).orderBy("month_idx")
    t = cm.select(key, "month_idx", dbl("revenue").alias("revenue"), dbl(F.row_number().over(w)).alias("x"))

    def ma(n, least):
        f = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count("revenue").over(f) >= least, F.avg("revenue").over(f))

    clip = lambda e: F.when(e.isNotNull(), F.least(F.greatest(e, F.lit(-cap)), F.lit(cap)))
    prev, year = F.lag("revenue").over(w), at_lag("revenue", [key], "month_idx", 12)
    six = w.rowsBetween(-5, 0)
    slope = F.when(F.count("revenue").over(six) >= min_history, F.regr_slope("revenue", "x").over(six))
    t = t.select(
        key, "month_idx", "revenue", ma(3, 2).alias("ma3"), ma(6, 3).alias("ma6"),
        F.when(prev > 1, clip((F.col("revenue") - prev) / prev * 100)).alias("mom"), F.when(year > 1, clip((F.col("revenue") - year) / year * 100)).alias("yoy"), F.round(slope, 6).alias("slope"),
    )
    return t.withColumn("direction", cases((F.col("slope").isNull(), "unknown"), (F.col("slope") > up, "up"), (F.col("slope") < down, "down"), default="flat"))


def series_slope(df: DataFrame, keys, value: str, min_points: int = 3) -> DataFrame:
    """OLS slope of a series over its row position; 0 with too few points."""
    x = dbl(F.row_number().over(Window.partitionBy(*keys).orderBy("month_idx")))
    return df.withColumn("_x", x).groupBy(*keys).agg(F.when(F.count(value) >= min_points, F.regr_slope(dbl(value), F.col("_x"))).otherwise(0.0).alias("slope"))


def category_migration(cpm: DataFrame, group: str = "product_line", min_share: float = 0.01) -> DataFrame:
    """Half-year share of each line in a customer's revenue, change of share and rank against the previous observed half."""
    half = F.floor((F.col("month_idx") - 1) / 6).cast("int")
    g = cpm.filter(F.col(group).isNotNull()).groupBy("customer_id", half.alias("half"), group).agg(F.sum("revenue").alias("v"))
    t = g.groupBy("customer_id", "half").agg(F.sum("v").alias("t")).filter(F.col("t") > 0)
    s = g.join(t, ["customer_id", "half"]).select("customer_id", "half", group, dbl("v").alias("revenue"), div("v", "t").alias("share")).filter(F.col("share") >= min_share)
    # Lines of one customer in one half and halves of one customer-line pair: both bounded by dimensions.
    s = s.withColumn("rank", F.dense_rank().over(Window.partitionBy("customer_id", "half").orderBy(F.desc("revenue"))))
    w = Window.partitionBy("customer_id", group).orderBy("half")
    return s.select("*", (F.col("share") - F.lag("share").over(w)).alias("share_change"), (F.col("rank") - F.lag("rank").over(w)).alias("rank_change"))


# --- studies over (product, month) panels --------------------------------------------------------------------


def _w(key="product_id"):
    return Window.partitionBy(key).orderBy("month_idx")


def label_next_rows(panel: DataFrame, n: int = 6, drop: float = 0.2) -> DataFrame:
    """1 if any of the next n rows is declining, or all their margins are <= 0 with a quantity drop over the limit."""
    f = _w().rowsBetween(1, n)
    nxt = F.avg("qty").over(f)
    bad = (F.max("margin").over(f) <= 0) & (nxt < F.col("qty") * (1 - drop))
    lab = F.when(F.coalesce(F.max(F.col("declining").cast("int")).over(f), F.lit(0)) == 1, 1).when(F.coalesce(bad, F.lit(False)), 1).otherwise(0)
    return panel.select("*", lab.alias("label"), F.count("*").over(f).alias("rows_ahead"))


def recovery(panel: DataFrame, before: int = 9, target: float = 0.8) -> DataFrame:
    """After the first declining row: ratios of the next 6 and 12 rows to the median before, first recovered row, pattern."""
    pos = F.row_number().over(_w())
    t = panel.select("product_id", "month_idx", "qty", "declining", pos.alias("i"))
    ev = t.filter("declining").groupBy("product_id").agg(F.min("i").alias("e"))
    j = t.join(ev, "product_id").withColumn("k", F.col("i") - F.col("e"))
    med = F.percentile(F.when(F.col("k").between(-before, -1), F.col("qty")), F.lit(0.5))
    base = j.groupBy("product_id").agg(med.alias("base"), F.avg(F.when(F.col("k").between(1, 6), F.col("qty"))).alias("a6"), F.avg(F.when(F.col("k").between(1, 12), F.col("qty"))).alias("a12")).filter(F.col("base") > 0)
    first = j.join(base, "product_id").filter((F.col("k") >= 1) & (F.col("qty") >= F.col("base") * target)).groupBy("product_id").agg(F.min("k").alias("first_recovered"))
    r6, r12 = F.col("a6") / F.col("base"), F.col("a12") / F.col("base")
    return base.join(first, "product_id", "left").select(
        "product_id", "base", r6.alias("ratio_6"), r12.alias("ratio_12"), "first_recovered", cases((r12 >= target, "recovered"), (r12 >= 0.5, "partial"), (r12.isNull(), "unknown"), default="not_recovered").alias("pattern")
    )


def rolling_slopes(panel: DataFrame, value: str = "qty", n: int = 6, half_life: float = 3.0) -> DataFrame:
    """OLS slope, exponentially weighted OLS slope and year-difference slope over the last n rows, all relative to the mean."""
    w = _w()
    f = w.rowsBetween(-(n - 1), 0)
    t = panel.select("product_id", "month_idx", dbl(value).alias("y"), dbl(F.row_number().over(w)).alias("x"))
    t = t.withColumn("yd", F.col("y") - at_lag("y", ["product_id"], "month_idx", 12))
    pts = F.collect_list(F.struct("x", "y")).over(f)
    t = t.select("*", F.count("*").over(f).alias("k"), F.avg("y").over(f).alias("m"), F.regr_slope("y", "x").over(f).alias("s"), F.regr_slope("yd", "x").over(f).alias("sd"), pts.alias("p"))
    wt = lambda z: F.pow(F.lit(0.5), (F.col("x") - z["x"]) / half_life)
    acc = lambda fn: F.aggregate("p", F.lit(0.0), lambda a, z: a + fn(z))
    t = t.withColumns({"sw": acc(wt), "sx": acc(lambda z: wt(z) * z["x"]), "sy": acc(lambda z: wt(z) * z["y"]), "sxy": acc(lambda z: wt(z) * z["x"] * z["y"]), "sxx": acc(lambda z: wt(z) * z["x"] * z["x"])})
    ew = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    rel = lambda s: F.when((F.col("k") >= 3) & (F.col("m") > 0), s / F.nullif(F.col("m"), F.lit(0.0)))
    return t.select("product_id", "month_idx", rel(F.col("s")).alias("slope_ols"), rel(ew).alias("slope_weighted"), rel(F.col("sd")).alias("slope_year"))


def severity(panel: DataFrame, value: str = "qty", n: int = 12, least: int = 6) -> DataFrame:
    """1 - min(mean of the next n rows / mean of the n before, 1); NULL with fewer than `least` rows on a side."""
    b, a = _w().rowsBetween(-n, -1), _w().rowsBetween(1, n)
    v = dbl(value)
    ok = (F.count(v).over(b) >= least) & (F.count(v).over(a) >= least) & (F.avg(v).over(b) > 0)
    return panel.select("product_id", "month_idx", F.when(ok, 1 - F.least(F.avg(v).over(a) / F.avg(v).over(b), F.lit(1.0))).alias("severity"))


def product_features(panel: DataFrame, n: int = 12) -> DataFrame:
    """Growth of the last n rows on the n before, drawdown from the running peak, margin against its running mean."""
    w = _w()
    f, all_before = w.rowsBetween(-(n - 1), 0), w.rowsBetween(Window.unboundedPreceding, 0)
    q = dbl("qty")
    t = panel.select("product_id", "month_idx", "qty", "margin", F.when(F.count(q).over(f) >= n, F.avg(q).over(f)).alias("m"))
    t = t.select("*", F.lag("m", n).over(w).alias("m0"), F.max("m").over(all_before).alias("peak"), F.avg("margin").over(all_before).alias("mm"))
    return t.select("product_id", "month_idx", div(F.col("m") - F.col("m0"), "m0").alias("growth"), (1 - div("m", "peak")).alias("drawdown"), div("margin", "mm").alias("self_health"))


def two_month_label(panel: DataFrame, limit: float = 0.8) -> DataFrame:
    """1 if the daily quantity of the next 2 calendar months is under 80 % of the last 6 months'."""
    w = Window.partitionBy("product_id").orderBy("month_idx")
    nxt, last = F.sum(dbl("qty")).over(w.rangeBetween(1, 2)), F.sum(dbl("qty")).over(w.rangeBetween(-5, 0))
    lab = F.when(F.coalesce(nxt, F.lit(0.0)) / 61.0 < last / 183.0 * limit, 1).otherwise(0)
    return panel.select("product_id", "month_idx", F.when(last > 0, lab).alias("label"))


def lead_time(panel: DataFrame, factors: dict) -> DataFrame:
    """Rows between the first alert of each factor and the first decline of the product (positive = early)."""
    pos = F.row_number().over(_w())
    t = panel.select("product_id", "declining", pos.alias("i"), *[F.coalesce(c_, F.lit(False)).alias(k) for k, c_ in factors.items()])
    g = t.groupBy("product_id").agg(F.min(F.when(F.col("declining"), F.col("i"))).alias("e"), *[F.min(F.when(F.col(k), F.col("i"))).alias(k) for k in factors]).filter(F.col("e").isNotNull())
    return g.unpivot(["product_id", "e"], list(factors), "factor", "alert").filter(F.col("alert") <= F.col("e")).select("product_id", "factor", (F.col("e") - F.col("alert")).alias("lead_rows"))
