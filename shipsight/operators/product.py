"""Product portrait: windows, growth, margins, momentum x health grid and risk score, at one or many cut-offs.

The cut-off is a column (`as_of`), so history is one job over (product, as_of) instead of one run per month.
Every group here is one product's monthly series at one cut-off, which the calendar bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series
from ..functions.core import cases, clip, count_if, dbl, div, top_k, total_if
from ..functions.settle import settle

KEYS = ["product_id", "as_of"]

# name: (months, months skipped before the cut-off)
WINDOWS = {"r12": (12, 0), "p12": (12, 12), "p24": (12, 24), "l3": (3, 0), "p3": (3, 3), "p6": (6, 6), "y3": (3, 12)}

# Momentum x health -> portrait, zone.
GRID = (
    ("accelerating", "healthy", "growth", "invest"),
    ("accelerating", "mild", "healthy_expansion", "invest"),
    ("accelerating", "severe", "warning_growth", "observe"),
    ("expanding", "healthy", "healthy_expansion", "invest"),
    ("expanding", "mild", "cash_cow", "maintain"),
    ("expanding", "severe", "warning_growth", "observe"),
    ("flat", "healthy", "profit_optimised", "maintain"),
    ("flat", "mild", "cash_cow", "maintain"),
    ("flat", "severe", "hidden_decline", "observe"),
    ("shrinking", "healthy", "active_contraction", "observe"),
    ("shrinking", "mild", "sunset", "exit"),
    ("shrinking", "severe", "decline", "exit"),
)

# Portrait -> standing advice.
BASE_STRATEGY = {
    "growth": "volume and profit rise: invest more",
    "healthy_expansion": "growing, watch margin: keep investing",
    "profit_optimised": "stable and profitable: optimise cost",
    "cash_cow": "harvest, monitor profit",
    "active_contraction": "volume falls, margin rises: may be a deliberate clean-up",
}

# Year-on-year group x decay group -> score.
DECAY_SCORES = {
    "high_growth": {"accelerating": 20, "stable": 10, "decelerating": 10},
    "growing": {"accelerating": 40, "stable": 30, "decelerating": 20},
    "flat": {"accelerating": 70, "stable": 60, "decelerating": 50},
    "shrinking": {"accelerating": 80, "stable": 80, "decelerating": 70},
}


def product_month(fact: DataFrame, extra=()) -> DataFrame:
    """Product x month sums with revenue of positive rows and distinct orders."""
    return fact.groupBy("product_id", "month_idx").agg(
        dbl(F.sum("qty")).alias("qty"),
        dbl(F.sum(F.greatest("revenue", F.lit(0)))).alias("rev_pos"),
        dbl(F.sum("profit")).alias("profit"),
        F.max("qty").alias("max_row_qty"),
        F.bool_or("is_new").alias("is_new"),
        F.max("category").alias("category"),
        F.max("product_line").alias("product_line"),
    ).withColumn("avg_price", div("rev_pos", "qty"))


def at_cutoffs(monthly: DataFrame, cutoffs) -> DataFrame:
    """Repeat each month for every cut-off that can see it; `back` counts months before the cut-off."""
    seen = F.filter(F.array(*[F.lit(int(t)) for t in cutoffs]), lambda t: t >= F.col("month_idx"))
    return monthly.withColumn("as_of", F.explode(seen)).withColumn("back", F.col("as_of") - F.col("month_idx"))


def _in(name: str):
    n, skip = WINDOWS[name]
    return (F.col("back") >= skip) & (F.col("back") < skip + n)


def window_aggregates(rows: DataFrame) -> DataFrame:
    """Quantity, revenue, profit and active months of all windows in one aggregate."""
    aggs = []
    for w in WINDOWS:
        aggs += [total_if(_in(w), m).alias(f"{w}_{s}") for m, s in (("qty", "q"), ("rev_pos", "r"), ("profit", "p"))]
        aggs.append(count_if(_in(w)).alias(f"{w}_m"))
    return rows.groupBy(*KEYS).agg(*aggs)


def product_info(rows: DataFrame, bulk_qty: float = 6000) -> DataFrame:
    return rows.groupBy(*KEYS).agg(
        F.min("month_idx").alias("first_idx"),
        F.max("month_idx").alias("last_idx"),
        F.count("*").alias("active_months"),
        (F.max("as_of") - F.min("month_idx") + 1).alias("age"),
        F.min(F.when(F.col("max_row_qty") >= bulk_qty, F.col("month_idx"))).alias("first_bulk_idx"),
        F.coalesce(F.bool_or(F.when(_in("r12"), F.col("is_new"))), F.lit(False)).alias("is_new"),
        count_if((F.col("back") < 24) & (F.col("qty") > 0)).alias("active_24m"),
        F.max("category").alias("category"),
        F.max("product_line").alias("product_line"),
    )


def concentration(cpm: DataFrame, cutoffs) -> DataFrame:
    """Top-1 and top-3 customer share of each product's 12 months before each cut-off."""
    seen = F.filter(
        F.array(*[F.lit(int(t)) for t in cutoffs]),
        lambda t: (t >= F.col("month_idx")) & (t < F.col("month_idx") + 12),
    )
    # Pre-aggregated to customer x product x month, so the fan-out is at most 12 per row.
    g = (
        cpm.withColumn("as_of", F.explode(seen)).groupBy(*KEYS, "customer_id").agg(dbl(F.sum("revenue")).alias("v"))
    )
    tot = g.groupBy(*KEYS).agg(F.sum("v").alias("t"), F.count("*").alias("n"))
    best = top_k(g, KEYS, [F.desc("v"), F.asc("customer_id")], 3).groupBy(*KEYS).agg(
        F.sum("v").alias("v3"), F.max(F.when(F.col("rank") == 1, F.col("v"))).alias("v1")
    )
    return tot.join(best, KEYS).select(
        *KEYS,
        F.coalesce(div("v1", "t"), F.lit(0.0)).alias("top1"),
        F.when(F.col("t") == 0, 0.0).when(F.col("n") < 3, 1.0).otherwise(div("v3", "t")).alias("top3"),
    )


def growth_window(a: DataFrame, min_months: int = 2, lo: float = -1.0, hi: float = 5.0) -> DataFrame:
    """Growth of the mean active month over 12, else 6, else 3 months; which window; whether clipped."""
    per = lambda q, m: F.when(m > 0, q / F.nullif(m, F.lit(0))).otherwise(0.0)
    def rate(rq, rm, pq, pm_):
        return (per(rq, rm) - pq / F.nullif(pm_, F.lit(0))) / F.nullif(pq / F.nullif(pm_, F.lit(0)), F.lit(0.0))
    x = F.col
    ok = lambda w: (x(f"{w}_m") >= min_months) & (x(f"{w}_q") > 0)
    raw = cases(
        (ok("p12"), rate(x("r12_q"), x("r12_m"), x("p12_q"), x("p12_m"))),
        (ok("p6"), rate(x("l3_q") + x("p3_q"), x("l3_m") + x("p3_m"), x("p6_q"), x("p6_m"))),
        (ok("p3"), rate(x("l3_q"), x("l3_m"), x("p3_q"), x("p3_m"))),
        default=0.0,
    )
    label = cases((ok("p12"), "12m"), (ok("p6"), "6m"), (ok("p3"), "3m"), default="none")
    return (
        a.withColumn("_raw", raw).withColumn("growth", clip("_raw", lo, hi)).withColumn("growth_window", label)
        .withColumn("growth_clamped", x("_raw") != x("growth")).drop("_raw")
    )


def margins(a: DataFrame) -> DataFrame:
    m = lambda p, r: F.when(F.col(r) > 0, F.col(p) / F.nullif(F.col(r), F.lit(0.0))).otherwise(0.0)
    rr = F.when(F.col("r12_m") > 0, F.col("r12_r") / F.nullif(F.col("r12_m"), F.lit(0))).otherwise(0.0)
    pr = F.col("p12_r") / F.nullif(F.col("p12_m"), F.lit(0))
    rev_g = F.when((F.col("p12_r") > 0) & (F.col("p12_m") >= 2), (rr - pr) / F.nullif(pr, F.lit(0.0))).otherwise(0.0)
    a = a.withColumns({"margin": m("r12_p", "r12_r"), "prior_margin": m("p12_p", "p12_r"), "rev_growth": clip(rev_g, -1.0, 5.0)})
    up, better = F.col("rev_growth") > 0, F.col("margin") > F.col("prior_margin")
    return a.withColumn("margin_yoy_pp", (F.col("margin") - F.col("prior_margin")) * 100).withColumn(
        "rev_profit",
        cases((up & better, "both_up"), (up, "revenue_up_margin_down"), (better, "revenue_down_margin_up"), default="both_down"),
    ).withColumn(
        "pareto",
        cases((F.col("r12_r") >= 1_000_000, "key"), (F.col("r12_r") >= 100_000, "regular"), default="potential"),
    )


def reference_margin(rows: DataFrame, info: DataFrame) -> DataFrame:
    """Historical and long reference margin: percentile of the product's positive monthly margins by age and depth."""
    pos = rows.withColumn("m", F.col("profit") / F.nullif(F.col("rev_pos"), F.lit(0.0))).filter(F.col("m") > 0)
    newest = F.row_number().over(Window.partitionBy(*KEYS).orderBy("back"))
    g = pos.withColumn("_r", newest).groupBy(*KEYS).agg(
        F.count("*").alias("n"),
        F.percentile("m", F.array(*[F.lit(p) for p in (0.95, 0.90, 0.50, 0.30)])).alias("q"),
        F.percentile(F.when(F.col("_r") <= 24, F.col("m")), F.lit(0.8)).alias("q_long"),
    )
    j = info.select(*KEYS, "age").join(g, KEYS, "left")
    q = F.col("q")
    hist = cases(
        (F.col("n").isNull(), 0.0),
        ((F.col("age") < 12) & (F.col("n") < 6), q[3]),
        (F.col("age") < 12, q[2]),
        (F.col("n") >= 20, q[0]),
        default=q[1],
    )
    return j.select(
        *KEYS, hist.alias("hist_margin"), F.when(F.col("age") >= 36, F.col("q_long")).alias("long_margin"),
        F.col("n").isNull().alias("no_hist"),
    )


def profit_slope(rows: DataFrame, sign: int = 1, months: int = 6, min_points: int = 3) -> DataFrame:
    """OLS slope of the non-negative monthly profit over its mean; `sign` 1 means positive is rising.

    Rounded to 10 places so that a flat series is exactly zero whatever the summation order.
    """
    r = rows.filter(F.col("back") < months).withColumn("y", F.greatest("profit", F.lit(0.0)))
    x = F.row_number().over(Window.partitionBy(*KEYS).orderBy("month_idx"))
    g = r.withColumn("x", dbl(x)).groupBy(*KEYS).agg(
        F.count("*").alias("slope_points"), F.regr_slope("y", "x").alias("s"), F.avg("y").alias("m"), F.max("y").alias("top")
    )
    return g.select(*KEYS, "slope_points", slope_ratio("s", "m", sign, min_points).alias("slope_ratio"), (F.col("top") <= 0.001).alias("zero_profit"))


def slope_ratio(s: str, m: str, sign: int = 1, min_points: int = 3):
    ratio = F.when((F.col("slope_points") >= min_points) & (F.col(m) > 0), F.lit(sign) * F.col(s) / F.nullif(F.col(m), F.lit(0.0)))
    return F.coalesce(F.round(ratio, 10), F.lit(0.0))


def slope_level(ratio, zero_profit, points, min_points: int = 3):
    return cases(
        (zero_profit, "no_profit"), (points < min_points, "too_few"), (ratio >= 0, "stable_or_rising"), (ratio > -0.003, "mild_decline"),
        (ratio > -0.008, "clear_erosion"), default="fast_erosion",
    )


def order_volatility(rows: DataFrame, low_volume: float = 1000) -> DataFrame:
    """std/mean of monthly quantities in 12 months; MAD/median for low volume; 0.5 for pulse shipping."""
    r = rows.filter(_in("r12"))
    med = F.percentile("qty", F.lit(0.5)).over(Window.partitionBy(*KEYS))
    g = r.withColumn("med", med).groupBy(*KEYS).agg(
        F.sum("qty").alias("q"), F.count("*").alias("n"), F.avg("qty").alias("mean"), F.stddev_samp("qty").alias("sd"),
        F.max("med").alias("med"), F.percentile(F.abs(F.col("qty") - F.col("med")), F.lit(0.5)).alias("mad"),
        count_if(F.col("qty") > 0).alias("act"),
    )
    cv, kind = volatility_class(*map(F.col, ("q", "n", "mean", "sd", "med", "mad", "act")), low_volume)
    return g.select(*KEYS, cv.alias("order_cv"), kind.alias("low_volume"))


def volatility_class(q, n, mean, sd, med, mad, act, low_volume: float = 1000):
    """(order_cv, low_volume) of the 12 months' sum, months, mean, deviation, median, MAD and months with sales."""
    low = (mean < low_volume) & (n >= 6)
    pulse = (act <= 4) & (q > low_volume)
    cv = cases(
        (q <= 0, F.lit(None).cast("double")),
        (low, F.when(med > 0, mad / F.nullif(med, F.lit(0.0))).otherwise(0.0)),
        (pulse, 0.5),
        default=F.when(mean > 0, sd / F.nullif(mean, F.lit(0.0))).otherwise(0.0),
    )
    return cv, cases((q <= 0, "yes"), (low, "yes"), (pulse, "pulse"), default="no")


def growth_decay(a: DataFrame) -> DataFrame:
    """3-month growth less 12-month growth in points, 3-month year-on-year change, prior growth and its direction."""
    per = lambda w: F.when(F.col(f"{w}_m") > 0, F.col(f"{w}_q") / F.nullif(F.col(f"{w}_m"), F.lit(0))).otherwise(0.0)
    rate = lambda n, d: F.when(per(d) > 0, (per(n) - per(d)) / F.nullif(per(d), F.lit(0.0)))
    prior = F.when(F.col("age") >= 24, F.coalesce(rate("p12", "p24"), F.lit(0.0)))
    change = cases((F.col("age") >= 24, (F.col("growth") - prior) * 100), (F.col("age") >= 12, F.col("growth") * 100))
    a = a.withColumns({
        "decay_pp": (F.coalesce(rate("l3", "p3"), F.lit(0.0)) - F.col("growth")) * 100,
        "yoy_3m": F.when(F.col("age") >= 15, rate("l3", "y3")),
        "prior_growth": prior,
        "growth_change_pp": change,
    })
    d = F.col("growth_change_pp")
    return a.withColumn("growth_direction", cases((d.isNull(), F.lit(None).cast("string")), (d > 0, "accelerating"), (d == 0, "flat"), default="decelerating"))


def decline_streak(rows: DataFrame, last_rows: int = 13) -> DataFrame:
    """Trailing consecutive falls of the monthly quantity within the newest rows."""
    w = Window.partitionBy(*KEYS)
    t = rows.select(
        *KEYS,
        F.row_number().over(w.orderBy("back")).alias("r"),
        (F.col("qty") < F.lag("qty").over(w.orderBy("month_idx"))).alias("fell"),
        F.count("*").over(w).alias("n"),
    )
    # The oldest row looked at has no predecessor inside the newest rows, so it always ends the run.
    stop = F.min(F.when(~F.coalesce("fell", F.lit(False)) | (F.col("r") >= F.least(F.lit(last_rows), "n")), F.col("r") - 1))
    return t.groupBy(*KEYS).agg(F.coalesce(stop, F.lit(0)).cast("int").alias("consecutive_falls"))


def asp_slope(rows: DataFrame, min_points: int = 3) -> DataFrame:
    x = F.row_number().over(Window.partitionBy(*KEYS).orderBy("month_idx"))
    r = rows.filter(_in("r12")).withColumn("x", dbl(x)).withColumn("y", F.when(F.col("avg_price") > 0, F.col("avg_price")))
    g = r.groupBy(*KEYS).agg(F.count("y").alias("n"), F.regr_slope("y", "x").alias("s"), F.avg("y").alias("m"))
    return g.select(*KEYS, F.when(F.col("n") >= min_points, F.round(F.col("s") / F.col("m"), 10)).otherwise(0.0).alias("asp_slope"), (F.col("n") >= min_points).alias("asp_reliable"))


def asp_direction(slope, up: float = 0.005, down: float = -0.005):
    return cases((slope > up, "rising"), (slope < down, "falling"), default="flat")


def joint_diagnosis(asp, margin, asp_t: float = -0.005, margin_t: float = -0.003):
    return cases(
        ((asp < asp_t) & (margin < margin_t), "price_war"), ((asp > asp_t) & (margin < margin_t), "cost_problem"),
        ((asp < asp_t) & (margin > margin_t), "scale_effect"), default="normal",
    )


def momentum_class(g, grow: float = 0.15, flat: float = -0.10):
    return cases((g > grow, "accelerating"), (g > 0, "expanding"), (g > flat, "flat"), default="shrinking")


def health_class(self_health, rel, healthy: float = 0.7, severe: float = 0.5, rel_limit: float = -10.0):
    return cases(
        ((self_health < severe) | (rel < rel_limit), "severe"), ((self_health >= healthy) & (rel >= 0), "healthy"), default="mild",
    )


def nine_grid(mom, health):
    """(portrait, zone) of the momentum x health grid as two expressions."""
    hit = [((mom == m) & (health == h), p, z) for m, h, p, z in GRID]
    return cases(*[(c_, p) for c_, p, _ in hit], default="unclassified"), cases(*[(c_, z) for c_, _, z in hit], default="watch")


def contextual_strategy(portrait, margin_yoy, rev_profit, qty12):
    """Advice text by portrait and margin change."""
    up = margin_yoy > 0
    p = portrait
    return cases(
        ((p == "decline") & up & (margin_yoy > 10), "margin recovers strongly: confirm it lasts before exit"),
        ((p == "decline") & up, "margin recovers a little: watch before exit"),
        ((p == "decline") & (qty12 == 0), "no shipments: confirm exit and clear stock"),
        (p == "decline", "volume and profit fall: plan exit"),
        ((p == "sunset") & up & (margin_yoy > 5), "margin clearly recovers: control stock, delay replacement"),
        ((p == "sunset") & up, "demand fades, profit fair: plan replacement"),
        (p == "sunset", "demand fades: prepare replacement"),
        ((p == "hidden_decline") & up, "margin below history but recovering: watch"),
        (p == "hidden_decline", "stable on the surface, profit erodes: warn"),
        ((p == "warning_growth") & (rev_profit == "revenue_down_margin_up"), "volume up, profit under its peak: follow the recovery"),
        (p == "warning_growth", "growth hides falling profit: check cost"),
        *[(p == k, v) for k, v in BASE_STRATEGY.items()],
        default="",
    )


def score_slope(ratio, no_trend=None):
    return cases((F.lit(False) if no_trend is None else no_trend, 80), (ratio.isNull(), 50), (ratio > 0, 10), (ratio > -0.008, 50), default=80)


def score_decay(decay, yoy, falls=None, per_month: int = 5, cap: int = 25):
    """Matrix score of year-on-year group x decay group, plus a bonus per month of consecutive decline."""
    yg = cases((yoy.isNull(), "unknown"), (yoy > 0.5, "high_growth"), (yoy > 0, "growing"), (yoy > -0.1, "flat"), default="shrinking")
    dg = cases((decay > 0, "accelerating"), (decay >= -10, "stable"), default="decelerating")
    cell = cases(*[((yg == y) & (dg == d), s) for y, row in DECAY_SCORES.items() for d, s in row.items()], default=50)
    bonus = F.lit(0) if falls is None else F.least(F.coalesce(falls, F.lit(0)) * per_month, F.lit(cap))
    return cases((decay.isNull(), 20), (bonus > 0, F.least(F.lit(100), cell + bonus)), default=cell)


def score_self_health(h, invalid):
    return cases((invalid | h.isNull(), 50), (h > 0.7, 10), (h > 0.5, 40), default=70)


def score_order_change(c6):
    return cases((c6.isNull(), 0), (c6 <= -0.5, 95), (c6 <= -0.2, 75), (c6 <= 0, 50), default=25)


def score_order_change_with_fallback(c6, available, fallback=0):
    """Second bucket table with an availability flag: 0, 30 or NULL when unavailable."""
    return F.when(available, score_order_change(c6)).otherwise(F.lit(fallback))


def composite(scores, weights, reliable):
    """Weighted mean of the reliable scores, weights renormalised; NULL when none is reliable."""
    w = [F.when(r, F.lit(float(x))).otherwise(0.0) for x, r in zip(weights, reliable)]
    total = sum(w[1:], w[0])
    num = sum((dbl(s) * x for s, x in zip(scores[1:], w[1:])), dbl(scores[0]) * w[0])
    return num / F.nullif(total, F.lit(0.0))


# Earlier threshold scores, kept for comparison with the current ones.
def old_slope(r, zero_profit):
    return cases((zero_profit, 80), (r >= 0, 10), (r > -0.003, 20), (r > -0.008, 50), default=80)


def old_cv(cv):
    return cases((cv.isNull(), 85), (cv < 0.5, 10), (cv < 1.0, 40), (cv < 1.5, 65), default=85)


def old_decay(decay, yoy):
    return cases(
        (decay.isNull(), 20),
        ((yoy > 0.5) & (decay <= 0), 10), ((yoy > 0.5) & (decay <= 10), 30), (yoy > 0.5, 50),
        ((yoy <= -0.1) & (decay <= -10), 80), ((yoy <= -0.1) & (decay <= 0), 70), ((yoy <= -0.1) & (decay <= 10), 60), (yoy <= -0.1, 50),
        (decay < -10, 70), (decay < 0, 50), default=20,
    )


def old_self_health(h):
    p = h * 100
    return cases((h.isNull(), 50), (p >= 70, 10), (p >= 50, 40), (p >= 30, 70), default=90)


def old_asp(asp, margin):
    return cases(
        (asp >= 0, 10), ((asp > -0.005) & (margin <= -0.003), 50), (asp > -0.005, 20), ((asp > -0.01) & (margin > -0.003), 20), (asp > -0.01, 50), default=80,
    )


def profile(pm: DataFrame, cpm: DataFrame, cutoffs, min_age: int = 3, bulk_qty: float = 6000) -> DataFrame:
    """All metrics of every product old enough at each cut-off, with its branch: zombie, new or normal.

    They are those of `product_info`, `window_aggregates`, `reference_margin`, `profit_slope`, `order_volatility`,
    `decline_streak`, `asp_slope` and `concentration`, computed over each product's series (see `functions/series.py`): months and
    customers are dealt by product once, and no row is repeated for each cut-off.
    """
    return profile_series(portrait_series(pm, cpm, cutoffs), cutoffs, min_age, bulk_qty)


def portrait_series(pm: DataFrame, cpm: DataFrame, cutoffs) -> DataFrame:
    """One written row per product: its months, and its customers' shares at each cut-off."""
    return settle(series.series(pm).join(series.customer_shares(cpm, cutoffs), "product_id", "left"))


def _branch_and_exit():
    zombie = (F.col("age") >= 24) & (F.col("active_24m") <= 1) & (F.col("r12_q") == 0)
    return {
        "branch": cases((zombie, "zombie"), (F.col("is_new"), "new"), default="normal"),
        "exited": (F.col("last_idx") <= F.col("as_of") - 12) & (F.col("last_idx") - F.col("first_idx") + 1 >= 3),
    }


def profile_series(rows: DataFrame, cutoffs, min_age: int = 3, bulk_qty: float = 6000) -> DataFrame:
    a = series.at_cutoffs(rows, cutoffs, WINDOWS, min_age, bulk_qty)
    a = growth_decay(margins(growth_window(a)))
    some = F.col("r12_m") > 0
    cv, kind = volatility_class(*map(F.col, ("_vq", "r12_m", "_vmean", "_vsd", "_vmed", "_vmad", "_vact")))
    a = a.withColumns({
        "slope_ratio": slope_ratio("_ps", "_pm"),
        "zero_profit": (F.col("slope_points") > 0) & (F.col("_pt") <= 0.001),
        "order_cv": F.when(some, cv),
        "low_volume": F.when(some, kind).otherwise("yes"),
        "asp_slope": F.when(F.col("_an") >= 3, F.coalesce(F.round(F.col("_as") / F.col("_am"), 10), F.lit(0.0))).otherwise(0.0),
        "asp_reliable": F.col("_an") >= 3,
    })
    a = a.na.fill(0.0, ["top1", "top3"]).select(*[x for x in a.columns if not x.startswith("_")])
    return a.withColumns({
        "branch": _branch_and_exit()["branch"],
        "negative_margin": ~F.col("no_hist") & (F.col("margin") < 0),
        "self_health": cases(
            (F.col("no_hist") | (F.col("margin") < 0), 0.0), (F.col("hist_margin") > 0, F.col("margin") / F.nullif(F.col("hist_margin"), F.lit(0.0))), default=1.0,
        ),
        "slope_short": ~F.col("zero_profit") & (F.col("slope_points") < 3),
        "slope_level": slope_level(F.col("slope_ratio"), F.col("zero_profit"), F.col("slope_points")),
        "asp_direction": asp_direction(F.col("asp_slope")),
        "joint_diagnosis": joint_diagnosis(F.col("asp_slope"), F.col("slope_ratio")),
        "exited": _branch_and_exit()["exited"],
    })


def reference_groups(p: DataFrame, groups=("category", "product_line"), min_n: int = 3, of: DataFrame | None = None) -> DataFrame:
    """Revenue-weighted margin of the first group level with enough products, else of the company.

    The groups' tables are written, so that Spark sees their size and need not deal the products by group. `of` is the frame
    that they are taken from, `p` unless given: one with fewer columns where `p` is costly.
    """
    base = (p if of is None else of).filter((F.col("branch") == "normal") & ~F.col("exited") & (F.col("r12_r") > 0))
    w = F.col("margin") * F.col("r12_r")
    level = F.array(*[F.struct(F.lit(i).alias("level"), F.col(g).cast("string").alias("name")) for i, g in enumerate(groups)], F.struct(F.lit(len(groups)).alias("level"), F.lit(None).cast("string").alias("name")))
    sums = settle(
        base.select("as_of", w.alias("_w"), "r12_r", F.explode(level).alias("g")).groupBy("as_of", "g.level", "g.name").agg((F.sum("_w") / F.sum("r12_r")).alias("m"), F.count("*").alias("n"))
    )
    company = sums.filter(F.col("level") == len(groups)).select("as_of", F.col("m").alias("company_margin"))
    out = p.join(company, "as_of", "left").na.fill(0.0, ["company_margin"])
    for i, g in enumerate(groups):
        s = sums.filter(F.col("level") == i).select("as_of", F.col("name").alias(g), F.col("m").alias(f"_{g}_m"), F.col("n").alias(f"_{g}_n"))
        out = out.join(s, ["as_of", g], "left")
    ok = [(F.col(f"_{g}_n") >= min_n, g) for g in groups]
    return out.withColumns({
        "group_margin": cases(*[(c_, F.col(f"_{g}_m")) for c_, g in ok], default=F.col("company_margin")),
        "group_source": cases(*[(c_, g) for c_, g in ok], default="company"),
    }).drop(*[f"_{g}_{s}" for g in groups for s in "mn"])


def score(p: DataFrame, weights=(0.1, 0.6, 0.2, 0.1), limits=(55, 65, 68), c6: str | None = None) -> DataFrame:
    """Momentum, health, grid portrait, factor scores, composite with floors and override, level, notes."""
    normal = F.col("branch") == "normal"
    rel = F.when(F.col("group_margin") > 0, (F.col("margin") - F.col("group_margin")) * 100).otherwise(0.0)
    p = p.withColumns({"relative_health_pp": rel, "vs_company_pp": (F.col("margin") - F.col("company_margin")) * 100})
    p = p.withColumns({"momentum": momentum_class(F.col("growth")), "health": health_class(F.col("self_health"), F.col("relative_health_pp"))})
    portrait, zone = nine_grid(F.col("momentum"), F.col("health"))
    p = p.withColumns({
        "portrait": cases((F.col("branch") == "zombie", "clearance"), (F.col("branch") == "new", "new_watch"), default=portrait),
        "zone": cases((F.col("branch") == "zombie", "exit"), (F.col("branch") == "new", "watch"), default=zone),
    })
    order_change = F.col(c6) if c6 else F.lit(None).cast("double")
    s4 = score_decay(F.col("decay_pp"), F.col("yoy_3m"), F.col("consecutive_falls"))
    burst = (F.col("growth") > 1.0) & (F.col("decay_pp") < -100)
    uncapped = burst & (F.col("yoy_3m") <= 0)
    p = p.withColumns({
        "strategy": contextual_strategy(F.col("portrait"), F.col("margin_yoy_pp"), F.col("rev_profit"), F.col("r12_q")),
        "s_slope": cases((F.col("slope_short"), 50), (F.col("zero_profit"), 80), default=score_slope(F.col("slope_ratio"))),
        "decay_cap_removed": F.coalesce(uncapped, F.lit(False)),
        "s_decay": F.when(burst & ~F.coalesce(uncapped, F.lit(False)), F.least(s4, F.lit(50))).otherwise(s4),
        "s_health": score_self_health(F.col("self_health"), F.col("no_hist")),
        "s_order": score_order_change(order_change),
    })
    names = ["s_slope", "s_decay", "s_health", "s_order"]
    ok = [~F.col("slope_short") & ~F.col("zero_profit"), F.lit(True), ~F.col("no_hist"), order_change.isNotNull()]
    total = composite([F.col(n) for n in names], weights, ok)
    rest = composite([F.col(n) for n in ("s_slope", "s_decay", "s_order")], (weights[0], weights[1], weights[3]), (ok[0], ok[1], ok[3]))
    parts = [F.when(o, F.col(n) * F.lit(float(x))).otherwise(0.0) for n, x, o in zip(names, weights, ok)]
    best = F.greatest(*parts)
    floor = (F.col("portrait") == "decline") & ((F.col("margin") <= 0) | (F.col("r12_q") <= 0)) & (rest < 50)
    p = p.withColumn("_t", F.when(floor, F.greatest(F.lit(50.0), total)).otherwise(total))
    override = (F.col("_t") <= limits[2]) & (F.col("s_decay") >= 80) & (F.col("s_slope") >= 70)
    p = p.withColumn("override", override).withColumn(
        "risk_score", F.when(normal, F.when(override, F.greatest(F.col("_t"), F.lit(limits[2] + 1.0))).otherwise(F.col("_t")))
    )
    r = F.col("risk_score")
    p = p.withColumns({
        "risk_level": cases((~normal, "unscored"), (r <= limits[0], "low"), (r <= limits[1], "medium"), (r <= limits[2], "high"), default="very_high"),
        "main_factor": F.when(normal, cases((parts[0] == best, "slope"), (parts[1] == best, "decay"), (parts[2] == best, "health"), default="order")),
        "quality": F.when(
            normal,
            F.coalesce(
                F.nullif(
                    F.concat_ws(
                        ",", *[
                            F.when(F.col(x) if isinstance(x, str) else x, F.lit(t))
                            for x, t in (("zero_profit", "ZP"), ("negative_margin", "NM"), ("slope_short", "SL"), ("growth_clamped", "GC"), (F.col("r12_q") == 0, "ZS"), ("no_hist", "NH"))
                        ],
                    ), F.lit(""),
                ), F.lit("reliable"),
            ),
        ),
    })
    return p.withColumn("notes", F.when(normal, notes())).drop("_t")


def notes():
    """Ordered list of conditional remarks as one string; urgent remarks come first."""
    x = F.col
    zero_sales = x("r12_q") == 0
    no_margin = x("no_hist") | (x("slope_level") == "no_profit")
    items = [
        (x("override"), "double factor override: very high risk"),
        (x("negative_margin"), "loss making over 12 months"),
        (zero_sales, "no shipments in 12 months"),
        (x("consecutive_falls") >= 4, F.concat(F.lit("volume fell "), x("consecutive_falls").cast("string"), F.lit(" months in a row: risk signal"))),
        (x("group_source") == "company", "too few peers: relative health for reference only"),
        (x("no_hist"), "no valid margin history"),
        (x("slope_level") == "no_profit", "no profit in the last months"),
        (x("growth_window") != "12m", F.concat(F.lit("growth based on window "), x("growth_window"))),
        (x("growth_direction") == "decelerating", "growth is slowing"),
        (x("top1") > 0.5, "depends on one customer"),
        (x("slope_level").isin("clear_erosion", "fast_erosion"), "profit falls steadily"),
        (~zero_sales & ~no_margin & (x("self_health") < 0.5) & (x("self_health") >= 0.3), "margin under half its reference"),
        (~zero_sales & ~no_margin & (x("relative_health_pp") < -10), "margin far under its group"),
        (x("order_cv").isNull(), "order volatility unknown"),
        (x("low_volume") == "pulse", "pulse shipping"),
        (x("slope_short"), "too few months for a trend"),
        (x("self_health") < 0.3, "margin severely worse than history"),
        (x("pareto") == "key", "key product: keep improving cost"),
        ((x("pareto") == "regular") & (x("growth") > 1.0), "fast growing regular product: invest"),
        (x("joint_diagnosis") == "price_war", "price and margin fall together"),
        (x("consecutive_falls").between(2, 3), F.concat(F.lit("volume fell "), x("consecutive_falls").cast("string"), F.lit(" months in a row"))),
        (x("growth_clamped"), "growth beyond the clip limit"),
        (x("decay_cap_removed"), "turned to real decline after a burst"),
        ((x("strategy").contains("exit") | x("strategy").contains("replacement")) & (x("rev_profit") == "revenue_down_margin_up"), "margin recovers: check the exit decision"),
        ((x("portrait") == "decline") & (x("margin_yoy_pp") > 5), "margin rebound: may be deliberate contraction"),
    ]
    text = F.concat_ws("; ", *[F.when(c_, t if not isinstance(t, str) else F.lit(t)) for c_, t in items])
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("no signal"))


def product_portrait(pm: DataFrame, cpm: DataFrame, cutoffs, **kw) -> DataFrame:
    rows = portrait_series(pm, cpm, cutoffs)
    base = series.at_cutoffs(rows, cutoffs, WINDOWS, kw.get("min_age", 3), kw.get("bulk_qty", 6000), whole=False)
    margin = F.when(F.col("r12_r") > 0, F.col("r12_p") / F.nullif(F.col("r12_r"), F.lit(0.0))).otherwise(0.0)
    return score(reference_groups(profile_series(rows, cutoffs, **kw), of=base.withColumns(_branch_and_exit() | {"margin": margin})))


def wide_history(history: DataFrame, latest: int, columns, offsets) -> DataFrame:
    """History rows turned into `<column>_t<n>` columns, one row per product."""
    aggs = [
        F.max(F.when(F.col("as_of") == latest - n, F.col(c_))).alias(f"{c_}_t{n}") for n in offsets for c_ in columns
    ]
    return history.groupBy("product_id").agg(*aggs)


def exited_lifespan(p: DataFrame, group: str = "category", min_n: int = 3) -> DataFrame:
    """Median life in months of exited products per group with enough of them (exact, distributed)."""
    from ..functions.distribution import quantiles

    e = p.filter("exited").withColumn("_life", F.col("last_idx") - F.col("first_idx") + 1)
    return quantiles(e, ["as_of", group], "_life", {"median_life": 0.5}, count_as="products").filter(F.col("products") >= min_n)
