"""Price levels, dispersion, fairness and price actions.

Per-product quantiles run over all customers of a product, which has no bound, so they use
`functions.distribution.quantiles` instead of the built-in buffer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import c, cases, clip, count_if, dbl, div, mean, sum_if, top_k, total_if, within
from ..functions.distribution import pct_rank, quantiles
from ..functions.settle import settle

BANDS = ("low", "mid", "high")


def price_bands(cpm: DataFrame) -> DataFrame:
    """Revenue of each customer by price band of the product (P25 and P75 of its row prices)."""
    q = quantiles(cpm, ["product_id"], "price", {"p25": 0.25, "p75": 0.75})
    cp = cpm.groupBy("customer_id", "product_id").agg(F.avg("price").alias("p"), F.sum("revenue").alias("r"))
    band = cases((F.col("p") <= F.col("p25"), "low"), (F.col("p") <= F.col("p75"), "mid"), default="high")
    g = (
        cp.join(q, "product_id", "left").withColumn("band", band).groupBy("customer_id")
        .agg(*[total_if(F.col("band") == b, "r").alias(f"{b}_revenue") for b in BANDS], dbl(F.sum("r")).alias("revenue"))
    )
    return g.select("*", *[div(f"{b}_revenue", "revenue").alias(f"{b}_share") for b in BANDS])


def price_dispersion(cpm: DataFrame, limit: float = 0.3, min_rows: int = 3) -> DataFrame:
    p = cpm.filter(F.col("price").isNotNull())
    stats = p.groupBy("product_id").agg(
        F.count("price").alias("rows"), F.avg("price").alias("mean_price"), F.stddev_samp("price").alias("std_price"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
    )
    q = quantiles(p, ["product_id"], "price", {"median_price": 0.5, "p25": 0.25, "p75": 0.75})
    cv = div("std_price", "mean_price")
    return stats.join(q, "product_id").select(
        "*", cv.alias("cv"), F.coalesce(cv > limit, F.lit(False)).alias("disordered"),
        F.when(F.col("rows") < min_rows, "too_few").otherwise("enough").alias("sample"),
    )


def customer_medians(cpm: DataFrame, keys=("customer_id", "product_id")) -> DataFrame:
    """Median monthly price of each customer-product pair (a calendar-bounded group)."""
    return cpm.filter(F.col("price").isNotNull()).groupBy(*keys).agg(F.percentile("price", F.lit(0.5)).alias("price"))


def price_variation(cpm: DataFrame, customers: DataFrame, min_customers: int = 2, high: float = 0.3, mid: float = 0.15) -> DataFrame:
    """Spread of customers' median prices per product, with the cheapest and dearest customer and their owners."""
    m = customer_medians(cpm)
    stats = m.groupBy("product_id").agg(
        F.count("*").alias("customers"), F.avg("price").alias("mean_price"), F.stddev_samp("price").alias("_sd"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        F.min(F.struct("price", "customer_id")).alias("_lo"),
        F.min(F.struct(-F.col("price"), "customer_id")).alias("_hi"),
    ).filter(F.col("customers") >= min_customers)
    q = quantiles(m, ["product_id"], "price", {"median_price": 0.5, "p25": 0.25, "p75": 0.75})
    cv = F.when(F.col("mean_price") > 0, F.col("_sd") / F.nullif(F.col("mean_price"), F.lit(0.0))).otherwise(0.0)
    rng = F.when(
        F.col("median_price") > 0,
        (F.col("max_price") - F.col("min_price")) / F.nullif(F.col("median_price"), F.lit(0.0)) * 100,
    ).otherwise(0.0)
    out = stats.join(q, "product_id").select(
        "product_id", "customers", "mean_price", "median_price", "p25", "p75", cv.alias("cv"), "min_price", "max_price",
        F.col("_lo.customer_id").alias("min_customer"), F.col("_hi.customer_id").alias("max_customer"),
        rng.alias("range_pct"),
        cases((cv > high, "high"), (cv > mid, "medium"), default="low").alias("level"),
    )
    who = customers.select("customer_id", "owner")
    return out.join(who.toDF("min_customer", "min_owner"), "min_customer", "left").join(
        who.toDF("max_customer", "max_owner"), "max_customer", "left"
    )


def channel_prices(cpm: DataFrame, customers: DataFrame, min_each: int = 3) -> DataFrame:
    """Mean customer median price per channel; products with enough customers on both sides."""
    m = customer_medians(cpm).join(customers.select("customer_id", "channel"), "customer_id")
    dis, dr = F.col("channel") == "distributor", F.col("channel") == "direct"
    g = m.groupBy("product_id").agg(
        F.avg(F.when(dis, F.col("price"))).alias("distributor_price"), F.avg(F.when(dr, F.col("price"))).alias("direct_price"),
        count_if(dis).alias("distributor_customers"), count_if(dr).alias("direct_customers"),
    ).filter((F.col("distributor_customers") >= min_each) & (F.col("direct_customers") >= min_each))
    return g.withColumn(
        "spread_pct",
        F.when(F.col("direct_price") > 0, div(F.col("distributor_price") - F.col("direct_price"), "direct_price") * 100),
    )


def owner_price_deviation(cpm: DataFrame, customers: DataFrame, k: int = 5, key_tiers=("KA", "AA"), small="MM", limit: float = 10.0) -> DataFrame:
    """Customer-product median against the product's market median, classed by tier and counted per owner."""
    info = customers.filter(F.col("owner").isNotNull()).select("customer_id", "owner", F.coalesce("tier", F.lit(small)).alias("tier"))
    cp = cpm.join(info, "customer_id")
    market = quantiles(cp, ["product_id"], "price", {"market": 0.5})
    m = cp.filter(F.col("price").isNotNull()).groupBy("customer_id", "product_id", "product_line", "owner", "tier").agg(
        F.percentile("price", F.lit(0.5)).alias("price")
    )
    dev = F.coalesce(div(F.col("price") - F.col("market"), "market") * 100, F.lit(0.0))
    m = m.join(market, "product_id", "left").withColumn("dev", dev)
    low, high = F.col("dev") < -limit, F.col("dev") > limit
    m = m.withColumn(
        "cls",
        cases(
            (F.col("tier").isin(*key_tiers) & low, "key_account_low"), ((F.col("tier") == small) & low, "small_low"),
            (low, "low"), (high, "high"), default="normal",
        ),
    )
    cls = F.col("cls")
    by_owner = m.groupBy("owner").agg(
        F.count("*").alias("pairs"), F.count_distinct("customer_id").alias("customers"),
        *[count_if(cls == x).alias(f"{x}_pairs") for x in ("key_account_low", "small_low", "low", "high")],
        count_if(F.col("tier") == small).alias("_small"),
    )
    ab = m.filter(cls == "small_low")
    worst = top_k(
        ab.groupBy("owner", "customer_id").agg(F.count("*").alias("n")), ["owner"], [F.desc("n"), F.asc("customer_id")], k
    ).groupBy("owner").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "customer_id", "n"))),
                lambda x: F.concat(x["customer_id"].cast("string"), F.lit("("), x["n"].cast("string"), F.lit(")")),
            ), "; ",
        ).alias("worst_customers")
    )
    line = top_k(
        ab.groupBy("owner", "product_line").agg(F.count("*").alias("n")), ["owner"], [F.desc("n"), F.asc("product_line")], 1
    ).select("owner", F.col("product_line").alias("main_low_line"), F.col("n").alias("_ln"))
    share = F.coalesce(div("small_low_pairs", "_small") * 100, F.lit(0.0))
    revenue = cp.groupBy("owner").agg(dbl(F.sum("revenue")).alias("revenue"))
    return by_owner.join(worst, "owner", "left").join(line, "owner", "left").join(revenue, "owner").select(
        "owner", "pairs", "customers", "key_account_low_pairs", "small_low_pairs", "low_pairs", "high_pairs", "revenue",
        share.alias("small_low_pct"), "worst_customers", "main_low_line",
        div("_ln", F.col("small_low_pairs")).alias("main_low_line_share"),
        cases(
            ((F.col("small_low_pairs") >= 10) & (share > 15), "too_many_low"), (F.col("small_low_pairs") >= 3, "watch"),
            (F.col("key_account_low_pairs") > 0, "normal_with_key_discount"), default="normal",
        ).alias("tendency"),
    )


def segment_prices(cpm: DataFrame, customers: DataFrame) -> DataFrame:
    """Mean row price per tier, region and line with an index against the overall mean (one pass, grouping sets)."""
    rows = cpm.join(customers.select("customer_id", "tier", "region"), "customer_id")
    dims = ["tier", "region", "product_line"]
    overall = cpm.agg(F.avg("price").alias("p")).scalar()
    g = rows.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        F.avg("price").alias("mean_price"), F.sum("revenue").alias("_r"), F.count("*").alias("rows"),
        F.count_distinct("customer_id").alias("customers"),
        *[F.grouping(d).alias(f"_g_{d}") for d in dims],
    )
    name = cases(*[(F.col(f"_g_{d}") == 0, d) for d in dims])
    return g.select(
        name.alias("dimension"), F.coalesce(*dims).alias("segment"), "mean_price",
        (F.col("mean_price") / overall * 100).alias("price_index"), "customers", dbl("_r").alias("revenue"), "rows",
    ).filter(F.col("segment").isNotNull())


TIER_POINTS = {"KA": 100, "AA": 75, "KM": 50, "MM": 25}
PARETO_POINTS = {"A": 100, "B": 80, "C": 60, "D": 30}


def pricing_fairness(cpm: DataFrame, customers: DataFrame, min_customers: int = 5, weights=(0.35, 0.25, 0.25, 0.15)) -> DataFrame:
    """Unit price of each customer-product pair against its product and channel, with a fairness score.

    Returns every scored pair; `low_price_anomaly` flags the unusually cheap ones. `customers` may carry
    `pareto`, `strategy_points` and `stability` from other operators.
    """
    cp = cpm.groupBy("customer_id", "product_id").agg(
        *[F.sum(x).alias(x) for x in ("revenue", "qty", "profit")]
    ).filter(F.col("qty") > 0)
    cp = cp.withColumn("price", div("revenue", "qty")).join(customers, "customer_id", "left")
    cp = settle(cp.withColumn("channel", F.coalesce("channel", F.lit("unknown"))))
    keys = ["product_id", "channel"]
    stats = cp.groupBy(*keys).agg(
        F.sum("revenue").alias("_pr"), F.count("*").alias("peers"), F.avg("price").alias("mean_price"),
        F.max("price").alias("max_price"), F.min(F.struct(-F.col("price"), "customer_id"))["customer_id"].alias("max_customer"),
    ).filter(F.col("peers") >= min_customers)
    q = quantiles(cp, keys, "price", {"p15": 0.15, "p25": 0.25, "p50": 0.50})
    own = cp.groupBy("customer_id").agg(F.sum("revenue").alias("_cr"))
    r = cp.join(stats, keys).join(q, keys).join(own, "customer_id")
    part = lambda t: F.when(F.col(t) > 0, div("revenue", t)).otherwise(0.0)
    r = r.withColumn("concentration", F.greatest(part("_pr"), part("_cr")))
    r = pct_rank(settle(r), [], "concentration", "_cp").withColumn("concentration_pct", F.col("_cp") * 100)
    tier_pts = cases(*[(F.col("tier") == t, float(p)) for t, p in TIER_POINTS.items()], default=25.0)
    volume = tier_pts
    if "pareto" in customers.columns:
        volume = cases(*[(F.col("pareto") == t, float(p)) for t, p in PARETO_POINTS.items()], default=tier_pts)
    strategy = F.coalesce(dbl("strategy_points"), F.lit(30.0)) if "strategy_points" in customers.columns else F.lit(30.0)
    stable = F.coalesce(dbl("stability"), F.lit(50.0)) if "stability" in customers.columns else F.lit(50.0)
    score = volume * weights[0] + F.col("concentration_pct") * weights[1] + strategy * weights[2] + stable * weights[3]
    flagged = (F.col("price") < F.col("p15")) & (F.coalesce("tier", F.lit("MM")) == "MM") & (strategy < 50)
    r = r.select(
        "customer_id", "product_id", "channel", "tier", "price", "p15", "p25", "p50", "mean_price", "peers", "max_customer", "max_price",
        F.when(F.col("revenue") > 0, div("profit", "revenue") * 100).otherwise(0.0).alias("margin_pct"),
        F.when(F.col("p50") > 0, (F.col("price") - F.col("p50")) / F.col("p50") * 100).otherwise(0.0).alias("gap_pct"),
        volume.alias("volume_points"), "concentration_pct", score.alias("fairness"), flagged.alias("low_price_anomaly"),
    )
    note = F.concat_ws(
        "; ", F.concat(F.lit("peers="), "peers"), F.concat(F.lit("channel="), "channel"),
        F.concat(F.lit("gap="), F.round(F.col("gap_pct") + 0.00000137, 0).cast("bigint").cast("string"), F.lit("%")),
        F.concat(F.lit("dearest="), F.col("max_customer").cast("string")),
    )
    return r.withColumn("note", note)


def markup_opportunity(cpm: DataFrame, ratio: float = 0.9, min_months: int = 6, max_share: float = 0.3) -> DataFrame:
    """Customer-product pairs priced under the product median, with the flag for raising the price."""
    med = quantiles(cpm, ["product_id"], "price", {"median_price": 0.5})
    tot = cpm.groupBy("product_id").agg(F.sum("qty").alias("_pq"))
    cp = cpm.groupBy("customer_id", "product_id").agg(
        F.avg("price").alias("mean_price"), dbl(F.sum("revenue")).alias("revenue"), dbl(F.sum("qty")).alias("qty"),
        F.count("price").alias("months"),
    )
    r = cp.join(med, "product_id", "left").join(tot, "product_id")
    share = div("qty", "_pq")
    return r.select(
        "customer_id", "product_id", "mean_price", "median_price", "revenue", "qty", "months", share.alias("qty_share"),
        (F.col("median_price") - F.col("mean_price")).alias("headroom"),
        div(F.col("median_price") - F.col("mean_price"), "median_price").alias("headroom_ratio"),
        F.coalesce(
            (F.col("mean_price") < F.col("median_price") * ratio) & (F.col("months") >= min_months)
            & (F.coalesce(share, F.lit(0.0)) <= max_share), F.lit(False),
        ).alias("can_raise"),
    )


def markdown_simulation(cpm: DataFrame, elasticity: float = -1.0, rates=(0.03, 0.05, 0.08, 0.10)) -> DataFrame:
    """Effect of price cuts per product: each product row is exploded over the rates."""
    g = cpm.groupBy("product_id").agg(
        dbl(F.sum("qty")).alias("q"), dbl(F.sum("revenue")).alias("r"), F.avg("price").alias("price")
    )
    g = g.withColumn("cut", F.explode(F.array(*[F.lit(x) for x in rates])))
    add = F.col("q") * abs(elasticity) * F.col("cut")
    new_price = F.col("price") * (1 - F.col("cut"))
    new_rev = new_price * (F.col("q") + add)
    return g.select(
        "product_id", "cut", "price", new_price.alias("new_price"), add.alias("added_qty"), new_rev.alias("new_revenue"),
        (new_rev - F.col("r")).alias("revenue_change"),
        F.when(new_rev - F.col("r") > 0, "try").otherwise("caution").alias("verdict"),
    )


def asp_trend(pm: DataFrame, min_points: int = 3) -> DataFrame:
    """OLS slope of the positive monthly prices over their mean, per product; x counts observed months."""
    x = F.row_number().over(Window.partitionBy("product_id").orderBy("month_idx")) - 1
    y = F.when(F.col("avg_price") > 0, F.col("avg_price"))
    g = pm.select("product_id", y.alias("y"), dbl(x).alias("x")).groupBy("product_id").agg(
        F.count("y").alias("points"), F.regr_slope("y", "x").alias("s"), F.avg("y").alias("m")
    )
    ok = F.col("points") >= min_points
    return g.select("product_id", "points", F.when(ok, F.col("s") / F.col("m")).otherwise(0.0).alias("asp_trend"))


def price_elasticity(pm: DataFrame, cap: float = 10.0, high: float = 1.5, mid: float = 0.8) -> DataFrame:
    """Median of quantity change over price change between observed months, after a 3 IQR trim.

    A product's changes are bounded by the calendar, so the built-in percentile is enough here.
    """
    w = Window.partitionBy("product_id").orderBy("month_idx")
    p0, q0 = F.lag("avg_price").over(w), dbl(F.lag("qty").over(w))
    base = lambda v: F.when(v > 0, v).otherwise(1.0)
    e = (
        pm.select(
            "product_id", ((F.col("avg_price") - p0) / base(p0)).alias("dp"), ((dbl("qty") - q0) / base(q0)).alias("dq")
        )
        .filter((F.abs("dp") > 1e-6) & F.col("dq").isNotNull())
        .select("product_id", (F.col("dq") / F.nullif(F.col("dp"), F.lit(0.0))).alias("e"))
    )
    b = e.groupBy("product_id").agg(
        F.percentile("e", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("pairs")
    ).filter(F.col("pairs") >= 2)
    q = F.col("q")
    span = 3 * (q[2] - q[0])
    inside = F.when((F.col("e") >= q[0] - span) & (F.col("e") <= q[2] + span), F.col("e"))
    med = e.join(b, "product_id").groupBy("product_id").agg(
        F.max("pairs").alias("pairs"), F.count(inside).alias("n"), F.percentile(inside, F.lit(0.5)).alias("m"),
        F.max(q[1]).alias("all"),
    )
    v = clip(F.when(F.col("n") >= 2, F.col("m")).otherwise(F.col("all")), -cap, cap)
    return med.select(
        "product_id", "pairs", v.alias("elasticity"),
        cases((F.abs(v) > high, "high"), (F.abs(v) > mid, "medium"), default="low").alias("sensitivity"),
    )


def order_frequency(orders: DataFrame, key: str, latest: int, up: float = 0.15, down: float = -0.10) -> DataFrame:
    """Orders per month of the last 3 months against the mean of the observed months in the 9 before."""
    m = orders.groupBy(key, "month_idx").agg(F.count_distinct("order_id").alias("n"))
    r, p = within(latest, 3), within(latest, 9, 3)
    g = m.groupBy(key).agg(
        (F.coalesce(F.sum(F.when(r, F.col("n"))), F.lit(0)) / 3.0).alias("recent_rate"),
        F.coalesce(div(F.sum(F.when(p, F.col("n"))), count_if(p)), F.lit(0.0)).alias("prior_rate"),
    )
    ch = F.coalesce(div(F.col("recent_rate") - F.col("prior_rate"), "prior_rate"), F.lit(0.0))
    return g.select(
        key, "recent_rate", "prior_rate", ch.alias("frequency_change"),
        cases((F.col("prior_rate") == 0, "no_reference"), (ch > up, "stronger"), (ch > down, "stable"), default="weaker").alias("frequency_trend"),
    )
