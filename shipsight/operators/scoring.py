"""Customer scores: RFM, RFM-pi, profit Pareto tiers, five-dimension composite, dual axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import buckets, cases, dbl, div
from ..functions.distribution import equal_depth, minmax_score, one_row, quantiles, running
from ..functions.settle import settle

# Indicator weights per dimension; True marks indicators where lower is better.
DIMENSIONS = {
    "value": {"revenue_12m": (0.4, False), "profit_12m": (0.3, False), "margin_12m": (0.2, False), "orders_12m": (0.1, False)},
    "growing": {"growth": (0.35, False), "streak_up": (0.2, False), "momentum": (0.25, False), "new_share": (0.2, False)},
    "stability": {"lifecycle_points": (0.3, False), "interrupted_points": (0.25, False), "streak_down": (0.25, True), "revenue_cv": (0.2, True)},
    "potential": {"products": (0.25, False), "lines": (0.25, False), "new_products": (0.25, False), "tier_points": (0.25, False)},
    "efficiency": {"low_share": (0.4, True), "stability_points": (0.3, False), "top3_share": (0.3, True)},
}
DIMENSION_WEIGHTS = {"value": 0.35, "growing": 0.25, "stability": 0.20, "potential": 0.15, "efficiency": 0.05}
LIFECYCLE_POINTS = {"mature": 100, "ramp": 80, "intro": 60, "decline": 40, "sleep": 20, "lost": 0}
STABILITY_POINTS = {"high": 100, "medium": 60, "volatile": 20}
TIER_POINTS = {"KA": 100, "AA": 75, "KM": 50, "MM": 25}
INACTIVE = 18.0


def points(col: str, table: dict, default: float = 50.0):
    return cases(*[(F.col(col) == k, float(v)) for k, v in table.items()], default=default)


def pareto_tiers(customers: DataFrame, profit: str = "profit_12m", revenue: str = "revenue_12m", cuts=(70.0, 90.0, 99.0), **kw) -> DataFrame:
    """A/B/C/D by cumulative share of profit over active customers, largest first; the customer that crosses a cut falls below it."""
    act = customers.filter(F.col(revenue) > 0).select("customer_id", dbl(profit).alias("_p"), (-dbl(profit)).alias("_o"))
    # Money with four decimals as an integer keeps the running sum exact in any order.
    r = running(act, [], ["_o", "customer_id"], {"p": F.round(F.col("_p") * 10000).cast("decimal(38,0)")}, **kw)
    share = div(F.col("p_before") + F.round(F.col("_p") * 10000).cast("decimal(38,0)"), "p_total") * 100
    tier = cases((F.col("p_total") <= 0, "D"), (share <= cuts[0], "A"), (share <= cuts[1], "B"), (share <= cuts[2], "C"), default="D")
    ranked = r.select("customer_id", share.alias("cumulative_pct"), tier.alias("pareto"))
    return customers.select("customer_id").join(ranked, "customer_id", "left").na.fill("D", ["pareto"])


def customer_tier(df: DataFrame, col: str = "tier", words=("KA", "AA", "KM", "MM"), default: str = "unclassified") -> DataFrame:
    return df.withColumn("tier_class", cases(*[(F.contains(F.col(col), F.lit(w)), w) for w in words], default=default))


def rfm(fact: DataFrame, churn_days: int = 90) -> DataFrame:
    """Recency, frequency, money quintiles, six segments, churn flag."""
    last = fact.agg(F.max("ship_date")).scalar()
    g = fact.groupBy("customer_id").agg(
        F.datediff(last, F.max("ship_date")).alias("recency"), F.count_distinct("ship_date").alias("frequency"), dbl(F.sum("revenue")).alias("money")
    )
    g = base = settle(g)
    for col, up in (("recency", False), ("frequency", True), ("money", True)):
        g = equal_depth(g, [], col, f"{col[0]}_score", ascending=up, dense=False, of=base)
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    seg = cases(
        ((r >= 4) & (f >= 4) & (m >= 4), "key_value"), ((r >= 4) & (f >= 4), "key_develop"), ((f >= 4) & (m >= 4), "key_keep"),
        ((r < 4) & (f < 4) & (m >= 4), "key_retain"), ((r >= 4) & (f < 4) & (m < 4), "new"), default="general",
    )
    return g.withColumns({"rfm_total": r + f + m, "segment": seg, "churned": F.col("recency") > churn_days})


RFM_PI_WEIGHTS = {"direct": (0.3, 0.2, 0.3, 0.2), "distributor": (0.25, 0.25, 0.25, 0.25)}


def rfm_pi(portrait: DataFrame, weights=RFM_PI_WEIGHTS, default=(0.3, 0.2, 0.3, 0.2), by_channel: bool = True) -> DataFrame:
    """Recency, interval, profit and new-product share quintiles, weighted by channel; tiers S/A/B/C.

    With `by_channel` each channel is scored in its own pool, otherwise all customers share one pool and the default weights.
    """
    keys = ["channel"] if by_channel else []
    g = base = settle(portrait.select("customer_id", "channel", "days_since", "interval_days", "profit_12m", "new_share"))
    for col, out, up in (("days_since", "r", False), ("interval_days", "f", False), ("profit_12m", "m", True), ("new_share", "p", True)):
        g = equal_depth(g, keys, col, f"{out}_score", ascending=up, of=base)
    known = weights if by_channel else {}
    total = sum(
        (cases(*[(F.col("channel") == ch, float(w[i])) for ch, w in known.items()], default=default[i]) if known else F.lit(default[i])) * F.col(f"{x}_score")
        for i, x in enumerate("rfmp")
    )
    return g.select("customer_id", "channel", *[f"{x}_score" for x in "rfmp"], total.alias("rfm_pi")).withColumn(
        "rfm_pi_tier", buckets("rfm_pi", ((4.0, "S"), (3.5, "A"), (2.5, "B")), "C")
    )


def dual_axis(active, value, growing, v_mid, g_mid):
    hi_v, hi_g = value >= v_mid, growing >= g_mid
    return cases((~active, "inactive"), (hi_v & hi_g, "star"), (hi_g, "potential"), (hi_v, "cash_cow"), default="dog")


def dimension_score(df: DataFrame, indicators: dict, active, stats):
    """Weighted mean of the min-max scores of one dimension, inactive customers get a fixed score."""
    total = F.lit(0.0)
    for name, (w, rev) in indicators.items():
        lo, hi = stats[f"{name}_lo"], stats[f"{name}_hi"]
        s = F.when(F.col(name).isNull() & (lo < hi), 0.0).otherwise(minmax_score(name, lo, hi, rev))
        total = total + F.when(active, s).otherwise(INACTIVE) * w
    return total / sum(w for w, _ in indicators.values())


def composite_scores(portrait: DataFrame) -> DataFrame:
    """Five dimension scores, composite tier, activity state, opportunity and risk ratings, dual-axis class."""
    df = portrait.withColumns({
        "lifecycle_points": points("lifecycle", LIFECYCLE_POINTS), "stability_points": points("stability", STABILITY_POINTS),
        "tier_points": points("tier", TIER_POINTS), "interrupted_points": F.when(F.col("interrupted"), 100.0).otherwise(0.0),
    })
    active = F.col("revenue_12m") > 0
    names = [n for d in DIMENSIONS.values() for n in d]
    lohi = df.filter(active).agg(
        *[F.min(dbl(n)).alias(f"{n}_lo") for n in names], *[F.max(dbl(n)).alias(f"{n}_hi") for n in names]
    )
    df = df.withColumn("_s", one_row(lohi))
    df = df.withColumns({f"{d}_score": dimension_score(df, ind, active, F.col("_s")) for d, ind in DIMENSIONS.items()}).drop("_s")
    comp = sum(F.col(f"{d}_score") * w for d, w in DIMENSION_WEIGHTS.items())
    df = df.withColumns({
        "composite": comp,
        "opportunity": F.col("growing_score") * 0.6 + F.col("potential_score") * 0.4,
        "risk": (100 - F.col("stability_score")) * 0.7 + (100 - F.col("efficiency_score")) * 0.3,
    })
    df = settle(df)
    act = df.filter(active)
    mids = act.select("customer_id", dbl("revenue_12m").alias("r"), F.col("value_score").alias("v"), F.col("growing_score").alias("g")).unpivot(["customer_id"], ["r", "v", "g"], "k", "x")
    q = quantiles(mids, ["k"], "x", {"p25": 0.25, "p50": 0.5})
    q = q.agg(
        F.max(F.when(F.col("k") == "r", F.col("p25"))).alias("r25"), F.max(F.when(F.col("k") == "v", F.col("p50"))).alias("v50"), F.max(F.when(F.col("k") == "g", F.col("p50"))).alias("g50")
    )
    df = df.withColumn("_q", one_row(q))
    return df.withColumns({
        "value_tier": F.when(active, buckets("composite", ((34, "S"), (28, "A"), (22, "B")), "C")).otherwise("dormant"),
        "activity": cases((~active, "inactive"), (F.col("revenue_12m") < F.col("_q.r25"), "slightly_active"), default="active"),
        "opportunity_level": buckets("opportunity", ((27, "very_high"), (20, "high"), (13, "medium")), "low"),
        "customer_risk": buckets("risk", ((85, "very_high"), (78, "high"), (60, "medium")), "low"),
        "dual_axis": dual_axis(active, F.col("value_score"), F.col("growing_score"), F.col("_q.v50"), F.col("_q.g50")),
    }).drop("_q", "lifecycle_points", "stability_points", "tier_points", "interrupted_points")


def true_profit(df: DataFrame, order_cost: float = 50.0, revenue_per_order: float = 5000.0, high: float = 35.0, low: float = 0.0) -> DataFrame:
    """Profit less order handling, its margin and three levels; missing order counts are estimated from revenue."""
    orders = F.coalesce(F.nullif(dbl("orders_12m"), F.lit(0.0)), F.greatest(F.lit(1.0), F.col("revenue_12m") / revenue_per_order))
    fee = F.when(F.col("revenue_12m") > 0, orders * order_cost).otherwise(0.0)
    margin = (F.coalesce("profit_12m", F.lit(0.0)) - fee) / F.greatest("revenue_12m", F.lit(1.0)) * 100
    return df.withColumns({
        "order_cost": fee, "true_profit": F.coalesce("profit_12m", F.lit(0.0)) - fee, "true_margin": margin,
        "profit_level": cases((margin >= high, "high"), (margin > low, "thin"), default="loss"),
    })


def clip_to_percentiles(df: DataFrame, cols, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Clip columns to their exact percentiles over all rows."""
    long = df.select(*[dbl(x).alias(x) for x in cols]).unpivot([], list(cols), "k", "x")
    q = quantiles(long, ["k"], "x", {"lo": lo, "hi": hi})
    bounds = one_row(q.agg(*[F.max(F.when(F.col("k") == x, F.col(s))).alias(f"{x}_{s}") for x in cols for s in ("lo", "hi")]))
    d = df.withColumn("_b", bounds)
    return d.withColumns({
        x: F.when(F.col(x).isNotNull(), F.least(F.greatest(dbl(x), F.col(f"_b.{x}_lo")), F.col(f"_b.{x}_hi"))) for x in cols
    }).drop("_b")


def scored_portrait(w) -> DataFrame:
    """Customer portrait with journey, volatility, RFM-pi, true profit, Pareto tier and composite scores."""
    from . import behaviour

    p = w.portrait()
    cm = w.customer_month()
    j = behaviour.journey_full(cm, w.latest, w.customers("channel")).drop("days_since", "first_month")
    v = behaviour.volatility(cm).withColumnRenamed("stability_score", "volatility_points")
    p = settle(p.join(j, "customer_id", "left").join(v, "customer_id", "left"))
    p = p.join(rfm_pi(p).select("customer_id", "rfm_pi", "rfm_pi_tier"), "customer_id", "left")
    p = true_profit(p).join(pareto_tiers(p).select("customer_id", "pareto"), "customer_id", "left")
    return composite_scores(settle(p))
