"""Product mix of customers: profiles, margin structure, associations, cross-sell, inventory risk, owners' aptitude."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import cases, clip, count_if, dbl, distinct_if, div, sum_if, top_k, total_if, within
from ..functions.distribution import one_row, pct_rank, quantiles
from ..functions.settle import settle


# --- inventory -----------------------------------------------------------------------------------------------

# Active months in the last 6 -> shares under 180 days, 180 days to 1 year, over 1 year.
AGING_SHARES = ((6, (0.80, 0.15, 0.05)), (3, (0.50, 0.30, 0.20)), (1, (0.20, 0.40, 0.40)))
AGING_IDLE = (0.10, 0.30, 0.60)
BUCKETS = ("under_180d", "d180_to_1y", "over_1y")


def _aging_shares(df: DataFrame) -> DataFrame:
    total = sum(F.col(b) for b in BUCKETS)
    return df.withColumn("stock", total).withColumns({
        "over_180d_share": F.coalesce((F.col("d180_to_1y") + F.col("over_1y")) / F.nullif(F.col("stock"), F.lit(0.0)), F.lit(0.0)),
        "over_1y_share": F.coalesce(F.col("over_1y") / F.nullif(F.col("stock"), F.lit(0.0)), F.lit(0.0)),
    })


def estimate_aging(pm: DataFrame, latest: int) -> DataFrame:
    """Stock of about two months' sales with age shares by how many of the last 6 months were active."""
    g = pm.groupBy("product_id").agg(
        F.sum(F.when(within(latest, 3), F.col("qty"))).alias("q"), count_if(within(latest, 6)).alias("act")
    ).filter(F.col("q").isNotNull())
    stock = dbl("q") / 3 * 2
    share = lambda i: cases(*[(F.col("act") >= n, s[i]) for n, s in AGING_SHARES], default=AGING_IDLE[i])
    return g.select(
        "product_id", stock.alias("stock"), *[(stock * share(i)).alias(b) for i, b in enumerate(BUCKETS)],
        (share(1) + share(2)).alias("over_180d_share"), share(2).alias("over_1y_share"), F.lit(True).alias("estimated"),
    )


def explode_to_finished(inv: DataFrame, bom: DataFrame, pm: DataFrame, latest: int) -> DataFrame:
    """Split material stock over its finished goods by 12-month sales, evenly where none sold, and add up per product."""
    sales = pm.filter(within(latest, 12)).groupBy("product_id").agg(dbl(F.sum("qty")).alias("q"))
    m = inv.join(bom.dropDuplicates(["material_id", "product_id"]), "material_id").join(sales, "product_id", "left")
    m = m.withColumn("q", F.coalesce("q", F.lit(0.0)))
    # Totals by group-by and join rather than a window, so a material used everywhere is not one task.
    t = m.groupBy("material_id").agg(F.sum("q").alias("t"), F.count("*").alias("k"))
    m = m.join(t, "material_id").withColumn("w", F.when(F.col("t") > 0, F.col("q") / F.nullif(F.col("t"), F.lit(0.0))).otherwise(1.0 / F.col("k")))
    g = m.groupBy("product_id").agg(*[F.sum(dbl(b) * F.col("w")).alias(b) for b in BUCKETS])
    return _aging_shares(g).withColumn("estimated", F.lit(False))


def choose_aging(pm: DataFrame, latest: int, inv: DataFrame | None = None, bom: DataFrame | None = None) -> DataFrame:
    """Real stock with bill of materials, else real stock as is, else the estimate."""
    if inv is None:
        return estimate_aging(pm, latest)
    if bom is None:
        return _aging_shares(inv.withColumnRenamed("material_id", "product_id")).withColumn("estimated", F.lit(False))
    return explode_to_finished(inv, bom, pm, latest)


def customer_inventory_risk(cpm: DataFrame, aging: DataFrame, stagnant: float = 0.3, dead: float = 0.1) -> DataFrame:
    """Counts and revenue shares of stagnant and dead products a customer buys; rows are customer x product x month."""
    j = cpm.join(aging.select("product_id", "over_180d_share", "over_1y_share"), "product_id", "left").na.fill(0.0, ["over_180d_share", "over_1y_share"])
    s, d = F.col("over_180d_share") > stagnant, F.col("over_1y_share") > dead
    g = j.groupBy("customer_id").agg(
        count_if(s).alias("stagnant_rows"), count_if(d).alias("dead_rows"), total_if(s, "revenue").alias("_s"), total_if(d, "revenue").alias("_d"),
        F.sum(F.col("over_180d_share") * dbl("revenue")).alias("_w"), dbl(F.sum("revenue")).alias("_t"),
    )
    part = lambda x: F.when(F.col("_t") > 0, F.col(x) / F.nullif(F.col("_t"), F.lit(0.0))).otherwise(0.0)
    return g.select("customer_id", "stagnant_rows", "dead_rows", part("_s").alias("stagnant_share"), part("_d").alias("dead_share"), part("_w").alias("over_180d_weighted"))


# --- margins and product profiles ----------------------------------------------------------------------------


def _pct(p, r):
    return F.when(F.col(r) > 0, div(p, r) * 100).otherwise(0.0)


def customer_products(cpm: DataFrame) -> DataFrame:
    return cpm.groupBy("customer_id", "product_id").agg(F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit")).withColumn("margin", _pct("profit", "revenue"))


def negative_margin(cpm: DataFrame, portrait: DataFrame | None = None, list_k: int = 20) -> DataFrame:
    """Loss-making products per customer: count, share, loss, profit recoverable by stopping them, severity, worst products."""
    cp = customer_products(cpm)
    neg = F.col("margin") < 0
    g = cp.groupBy("customer_id").agg(
        F.sum("revenue").alias("_r"), F.sum("profit").alias("_p"), F.count("*").alias("products"), count_if(neg).alias("loss_products"), total_if(neg, "profit").alias("loss")
    )
    worst = top_k(cp.filter(neg), ["customer_id"], [F.asc("profit"), F.asc("product_id")], list_k).groupBy("customer_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "product_id"))), lambda x: x["product_id"].cast("string")), "; ").alias("worst_products")
    )
    g = g.withColumns({"overall_margin": _pct("_p", "_r"), "loss_product_pct": F.col("loss_products") / F.col("products") * 100, "revenue": dbl("_r"), "recoverable": F.greatest(-F.col("loss"), F.lit(0.0))})
    loss = F.abs("loss")
    ratio = F.when(F.col("revenue") > 0, loss / F.nullif(F.col("revenue"), F.lit(0.0))).otherwise(0.0)
    sev = cases(
        (F.col("loss_products") == 0, "none"), (loss > 150_000, "severe"), (F.col("overall_margin") < 0, "severe"), (loss > 100_000, "watch"),
        ((F.col("loss_product_pct") > 30) | (ratio > 0.1), "severe"), ((F.col("loss_product_pct") > 15) | (ratio > 0.05), "watch"), default="slight",
    )
    g = g.withColumn("severity", sev)
    if portrait is not None:
        g = g.join(portrait.select("customer_id", "revenue_12m"), "customer_id", "left").withColumn(
            "severity", F.when((F.coalesce("revenue_12m", F.lit(0.0)) <= 0) & (F.col("severity") == "severe"), "watch").otherwise(F.col("severity"))
        ).drop("revenue_12m")
    advice = cases(
        (F.col("severity") == "none", ""), (F.col("overall_margin") < 0, "urgent: review pricing"), (F.col("severity") == "severe", "stop or reprice loss products"),
        (F.col("severity") == "watch", "review loss products one by one"), default="adjust price when possible",
    )
    return g.join(worst, "customer_id", "left").select(
        "customer_id", "products", "loss_products", "loss_product_pct", "revenue", "overall_margin", "loss", "recoverable", "severity", "worst_products", advice.alias("advice")
    )


def product_profiles(cpm: DataFrame, k: int = 5) -> DataFrame:
    """Top products by revenue, by profit and by loss, overall margin and dominant line of each customer."""
    cp = customer_products(cpm)

    def best(rows, order, value, out):
        t = top_k(rows, ["customer_id"], order, k)
        item = F.struct("rank", "product_id", dbl(value).alias("value"), "margin")
        return t.groupBy("customer_id").agg(F.array_sort(F.collect_list(item)).alias(out))

    tot = cp.groupBy("customer_id").agg(dbl(F.sum("revenue")).alias("revenue"), dbl(F.sum("profit")).alias("profit"), F.count("*").alias("products")).withColumn("overall_margin", _pct("profit", "revenue"))
    line = top_k(
        cpm.groupBy("customer_id", "product_line").agg(F.sum("revenue").alias("v")), ["customer_id"], [F.desc("v"), F.asc("product_line")], 1, "_r"
    ).select("customer_id", F.col("product_line").alias("main_line"))
    out = tot.join(line, "customer_id", "left")
    for rows, order, value, name in (
        (cp, [F.desc("revenue"), F.asc("product_id")], "revenue", "top_revenue"),
        (cp.filter(F.col("profit") > 0), [F.desc("profit"), F.asc("product_id")], "profit", "top_profit"),
        (cp.filter(F.col("profit") < 0), [F.asc("profit"), F.asc("product_id")], "profit", "top_loss"),
    ):
        out = out.join(best(rows, order, value, name), "customer_id", "left")
    return out


def product_label(revenue, margin, overall):
    return cases((margin < 0, "drain"), (margin > overall * 1.3, "star"), ((revenue > 0) & (margin > 0), "volume"), default="ordinary")


def drain_and_star(profiles: DataFrame) -> DataFrame:
    """Among a customer's top products: the largest margin drag and the largest profit above the overall margin."""
    t = profiles.select("customer_id", "revenue", "profit", "overall_margin", F.explode("top_revenue").alias("x")).select(
        "customer_id", "overall_margin", F.col("profit").alias("total_profit"), F.col("x.product_id").alias("product_id"), F.col("x.value").alias("v"), F.col("x.margin").alias("m"), "revenue"
    )
    drag = F.when((F.col("m") < F.col("overall_margin")) & (F.col("revenue") > 0), (F.col("overall_margin") - F.col("m")) * F.col("v") / F.nullif(F.col("revenue"), F.lit(0.0)))
    gain = F.when(F.col("m") > F.col("overall_margin"), F.col("v") * F.col("m") / 100)
    t = t.select("*", F.when(drag > 0, drag).alias("drag"), F.when(gain > 0, gain).alias("gain"), product_label(F.col("v"), F.col("m"), F.col("overall_margin")).alias("label"))
    pick = lambda x: F.min_by("product_id", F.when(F.col(x).isNotNull(), F.struct(-F.col(x), F.col("product_id"))))
    return t.groupBy("customer_id").agg(
        pick("drag").alias("drain_product"), F.max("drag").alias("drag_pp"), pick("gain").alias("star_product"), F.max("gain").alias("star_profit"),
        *[count_if(F.col("label") == x).alias(f"{x}_products") for x in ("drain", "star", "volume")],
    )


def margin_structure(profiles: DataFrame, tiers: DataFrame, peers=("S", "A")) -> DataFrame:
    """Top-5 share, margin against the median of peer customers, worst loss and best profit product."""
    p = profiles.join(tiers.select("customer_id", "value_tier"), "customer_id", "left")
    med = quantiles(p.filter(F.col("value_tier").isin(*peers)), [], "overall_margin", {"m": 0.5}).agg(F.max("m")).scalar()
    top5 = F.aggregate("top_revenue", F.lit(0.0), lambda a, x: a + x["value"])
    p = p.withColumn("peer_margin", med)
    om, pmg = F.col("overall_margin"), F.col("peer_margin")
    return p.select(
        "customer_id", F.when(F.col("revenue") > 0, top5 / F.col("revenue") * 100).otherwise(0.0).alias("top5_pct"), "overall_margin", "peer_margin",
        cases((pmg.isNull(), "unknown"), (om > pmg * 1.1, "above"), (om < pmg * 0.9, "below"), default="equal").alias("versus_peers"),
        F.col("top_loss")[0]["product_id"].alias("drain_product"), F.col("top_profit")[0]["product_id"].alias("star_product"),
    )


def declining_products(cpm: DataFrame, k: int = 5, limit: float = -20.0) -> DataFrame:
    """Per customer: products whose revenue fell by over 20 % from the 3 observed months before to the last 3."""
    months = cpm.select("customer_id", "month_idx").distinct()
    w = Window.partitionBy("customer_id")
    months = months.select("*", F.row_number().over(w.orderBy(F.desc("month_idx"))).alias("r"), F.count("*").over(w).alias("n")).filter((F.col("n") >= 4) & (F.col("r") <= 6))
    j = cpm.join(months, ["customer_id", "month_idx"])
    g = j.groupBy("customer_id", "product_id").agg(total_if(F.col("r") <= 3, "revenue").alias("recent"), total_if(F.col("r") > 3, "revenue").alias("prior"))
    d = g.filter((F.col("prior") > 0) & (F.col("recent") < F.col("prior"))).select(
        "*", ((F.col("recent") - F.col("prior")) / F.col("prior") * 100).alias("change_pct"), (F.col("prior") - F.col("recent")).alias("loss")
    ).filter(F.col("change_pct") < limit)
    return top_k(d, ["customer_id"], [F.asc("change_pct"), F.asc("product_id")], k)


def best_window(cm: DataFrame, cpm: DataFrame | None = None, n: int = 12) -> DataFrame:
    """Best run of 12 observed months of each customer, its profit and margin, and the customer's best product."""
    w = Window.partitionBy("customer_id").orderBy("month_idx").rowsBetween(0, n - 1)
    t = cm.select(
        "customer_id", "month", F.sum("revenue").over(w).alias("r"), F.sum("profit").over(w).alias("p"), F.max("month").over(w).alias("to_month"), F.count("*").over(w).alias("k")
    ).filter((F.col("k") == n) & (F.col("r") > 0))
    b = top_k(t, ["customer_id"], [F.desc("r"), F.asc("month")], 1, "_r").select(
        "customer_id", F.col("month").alias("from_month"), "to_month", dbl("r").alias("best_revenue"), dbl("p").alias("best_profit"), (div("p", "r") * 100).alias("best_margin")
    )
    if cpm is None:
        return b
    g = cpm.groupBy("customer_id", "product_id").agg(F.sum("revenue").alias("v"))
    top = top_k(g, ["customer_id"], [F.desc("v"), F.asc("product_id")], 1, "_r").select("customer_id", F.col("product_id").alias("best_product"), dbl("v").alias("best_product_revenue"))
    return b.join(top, "customer_id", "left")


# --- research, owners ----------------------------------------------------------------------------------------


def rd_recommendations(pm: DataFrame, cpm: DataFrame, tiers: DataFrame, latest: int, high=("KA", "AA", "KM")) -> DataFrame:
    """Per product over 6 months: growth on a year ago, CV, share of high tiers, preference index, rigidity, advice."""
    r6 = within(latest, 6)
    g = pm.groupBy("product_id").agg(
        total_if(r6, "revenue").alias("rev"), total_if(r6, "qty").alias("q"), total_if(r6, "profit").alias("p"), total_if(within(latest, 6, 12), "qty").alias("q_yoy"),
        F.stddev_samp(F.when(r6, dbl("qty"))).alias("sd"), F.avg(F.when(r6, dbl("qty"))).alias("mean"), count_if(r6).alias("n"),
    ).filter((F.col("rev") > 0) & (F.col("q") > 0))
    c = cpm.filter(r6).join(tiers.select("customer_id", "tier"), "customer_id", "left").withColumn("hi", F.coalesce(F.col("tier").isin(*high), F.lit(False)))
    base = c.agg((div(F.sum(F.when(F.col("hi"), F.col("revenue"))), F.sum("revenue")) * 100).alias("b")).scalar()
    pc = c.groupBy("product_id").agg(total_if(F.col("hi"), "revenue").alias("hr"), distinct_if(F.col("hi"), "customer_id").alias("high_customers"), F.count_distinct("customer_id").alias("customers"))
    t = g.join(pc, "product_id", "left").withColumns({
        "growth_yoy": F.when(F.col("q_yoy") > 0, (F.col("q") - F.col("q_yoy")) / F.nullif(F.col("q_yoy"), F.lit(0.0)) * 100),
        "cv": F.when((F.col("mean") > 0) & (F.col("n") > 1), F.col("sd") / F.nullif(F.col("mean"), F.lit(0.0))).otherwise(0.0),
        "high_share": F.col("hr") / F.col("rev") * 100, "margin": F.col("p") / F.col("rev") * 100, "asp": F.col("rev") / F.col("q"), "base": base,
    }).withColumn("hpi", F.coalesce(F.col("high_share") / F.nullif(F.col("base"), F.lit(0.0)), F.lit(0.0)))
    return t.select(
        "product_id", (F.col("q") / 6).alias("monthly_qty"), (F.col("rev") / 6).alias("monthly_revenue"), "margin", "growth_yoy", "high_share", "hpi", "high_customers", "customers", "cv", "asp",
        cases(((F.col("cv") < 0.3) & (F.col("customers") >= 5), "high"), (F.col("cv") < 0.8, "medium"), default="low").alias("rigidity"),
        cases(
            ((F.col("hpi") > 1.3) & (F.col("customers") >= 10) & (F.col("cv") < 0.8), "second_generation"), ((F.col("rev") > 500_000) & (F.col("margin") < 20), "cut_cost"),
            ((F.col("customers") >= 20) & (F.col("high_share") < 30), "key_account_push"), ((F.col("growth_yoy") < -30) & (F.col("margin") < 20), "replace"), default="observe",
        ).alias("recommendation"),
    )


def category_aptitude(cpm: DataFrame, owners: DataFrame) -> DataFrame:
    """Owner x line scores: profit quality, growth, new products, pricing, cross-selling; composite, type, confidence, trend."""
    x = settle(cpm.join(owners.select("customer_id", "owner"), "customer_id").filter(F.col("owner").isNotNull()))
    price = F.when(F.col("qty") > 0, F.col("price"))
    comp = x.groupBy("product_line").agg((F.sum(dbl("profit")) / F.greatest(F.sum(dbl("revenue")), F.lit(1.0)) * 100).alias("cm"), dbl(F.sum("revenue")).alias("crev"))
    comp = comp.join(quantiles(x, ["product_line"], price, {"cp": 0.5}), "product_line", "left")
    med = quantiles(x, ["owner", "product_line"], price, {"op": 0.5})
    last = x.groupBy("owner", "product_line").agg(F.max("month_idx").alias("lm"))
    y = x.join(last, ["owner", "product_line"])
    g = y.groupBy("owner", "product_line").agg(
        dbl(F.sum("revenue")).alias("rev"), dbl(F.sum("profit")).alias("p"), F.count_distinct("customer_id").alias("customers"),
        total_if(F.col("month_idx") >= F.col("lm") - 6, "revenue").alias("r6"), total_if((F.col("month_idx") < F.col("lm") - 6) & (F.col("month_idx") >= F.col("lm") - 12), "revenue").alias("p6"),
        total_if(F.col("is_new"), "revenue").alias("nr"),
    )
    pairs = x.select("owner", "customer_id", "product_line").distinct()
    several = pairs.groupBy("owner", "customer_id").agg(F.count("*").alias("k")).filter(F.col("k") > 1)
    cross = pairs.join(several, ["owner", "customer_id"]).groupBy("owner", "product_line").agg(F.count("*").alias("x"))
    t = g.join(comp, "product_line").join(med, ["owner", "product_line"], "left").join(cross, ["owner", "product_line"], "left")
    mg = F.col("p") / F.greatest("rev", F.lit(1.0)) * 100
    dev = (mg - F.col("cm")) / F.greatest(F.abs("cm"), F.lit(1.0)) * 100
    share = F.when(F.col("crev") > 0, F.col("p") / F.greatest("crev", F.lit(1.0)) * 100).otherwise(0.0)
    t = t.withColumns({
        "margin": mg, "margin_dev": dev, "profit_score": clip(50 + dev * 0.5 + share * 2, 0, 100),
        "growth_score": F.when(F.col("p6") > 0, clip(50 + (F.col("r6") - F.col("p6")) / F.nullif(F.col("p6"), F.lit(0.0)) * 100, 0, 100)).otherwise(50.0),
        "new_score": F.least(F.lit(100.0), F.col("nr") / F.greatest("rev", F.lit(1.0)) * 100 * 5),
        "pricing_score": clip(50 + F.coalesce(F.when(F.col("cp") > 0, (F.col("op") - F.col("cp")) / F.greatest("cp", F.lit(1.0)) * 100), F.lit(0.0)) * 2, 0, 100),
        "cross_score": F.least(F.lit(100.0), F.coalesce("x", F.lit(0)) / F.col("customers") * 100 * 0.8),
    })
    return t.select(
        "owner", "product_line", "rev", "margin", "customers", "profit_score", "growth_score", "new_score", "pricing_score", "cross_score",
        (F.col("profit_score") * 0.3 + F.col("growth_score") * 0.25 + F.col("new_score") * 0.2 + F.col("pricing_score") * 0.15 + F.col("cross_score") * 0.1).alias("composite"),
        cases(((F.col("margin_dev") > 10) & (F.col("profit_score") > 60), "profit"), (F.col("new_score") > 60, "new_products"), (F.col("growth_score") > 60, "growth"), default="traffic").alias("aptitude"),
        F.least(F.lit(95), F.greatest(F.lit(30), F.col("customers") * 5 + 30)).alias("confidence"),
        cases((F.col("growth_score") > 65, "rising"), (F.col("growth_score") > 45, "stable"), default="falling").alias("trend"),
    )


PROFILE_WEIGHTS = {"absolute": 0.35, "retention": 0.1, "category": 0.1, "pricing": 0.06, "acquisition": 0.08, "activation": 0.06, "upgrade": 0.1, "mix": 0.08, "diversification": 0.07}


def _log10(x):
    return F.log10(F.greatest(dbl(x), F.lit(1.0)))


def sales_profile(portrait: DataFrame, losses: DataFrame | None = None, today_months: int | None = None, strategies: DataFrame | None = None) -> DataFrame:
    """Nine capability scores per owner with weighted composite, revenue class, size subgroup and grade.

    `losses` adds loss_products, `strategies` adds strategy; the scores that need them stay at their base without them.
    """
    p = portrait.filter(F.col("owner").isNotNull() & (F.col("owner") != "unknown"))
    p = p.join(losses.select("customer_id", "loss_products"), "customer_id", "left") if losses is not None else p.withColumn("loss_products", F.lit(None).cast("bigint"))
    p = p.join(strategies.select("customer_id", "strategy"), "customer_id", "left") if strategies is not None else p.withColumn("strategy", F.lit(None).cast("string"))
    p = settle(p.withColumns({
        "key": F.col("tier").isin("KA", "AA"), "fresh": F.col("lifecycle").isin("intro", "ramp"), "react": F.col("journey") == "reactivated", "revived": F.coalesce(F.col("strategy") == "reactivate", F.lit(False)),
    }))
    owner_rev = p.groupBy("owner").agg(F.sum("revenue_12m").alias("_or"))
    med = p.select("owner", "growth", dbl("margin_12m").alias("margin_12m")).unpivot(["owner"], ["growth", "margin_12m"], "k", "v")
    med = quantiles(med, ["owner", "k"], "v", {"m": 0.5}).groupBy("owner").agg(F.max(F.when(F.col("k") == "growth", F.col("m"))).alias("mg"), F.max(F.when(F.col("k") == "margin_12m", F.col("m"))).alias("mm"))
    old = F.col("first_idx_age") >= 24 if "first_idx_age" in p.columns else F.lit(False)
    g = p.join(owner_rev, "owner").groupBy("owner").agg(
        F.count("*").alias("n"), F.sum("revenue_12m").alias("rev"), F.sum("profit_12m").alias("prof"), count_if(F.col("revenue_12m") > 0).alias("act"), count_if(old).alias("old"),
        count_if(F.col("key")).alias("key_customers"), count_if(~F.col("key")).alias("nk"), count_if(~F.col("key") & (F.col("profit_level") == "high")).alias("nk_high"), count_if(F.col("profit_level") == "high").alias("high"),
        count_if(F.col("loss_products") > 0).alias("neg"), F.avg("low_share").alias("low"), count_if(F.col("fresh")).alias("fresh"),
        count_if(F.col("fresh") & F.col("value_tier").isin("S", "A", "B")).alias("fresh_good"), count_if(F.col("react") & F.col("days_since").between(1, 365)).alias("re1"),
        count_if(F.col("react") & F.col("days_since").between(366, 730)).alias("re2"), count_if(F.col("react") & (F.col("days_since") > 730)).alias("re3"),
        count_if(F.col("categories") >= 3).alias("multi"), count_if(F.col("new_share") > 0).alias("has_new"), F.avg("new_share").alias("avg_new"),
        count_if(~F.col("key") & F.col("value_tier").isin("S", "A")).alias("nk_sa"), count_if(F.col("revived")).alias("s6"), count_if(F.col("revived") & F.col("lifecycle").isin("intro", "ramp", "mature")).alias("s6_ok"),
        F.sum(F.when(F.col("_or") > 0, (F.col("revenue_12m") / F.nullif(F.col("_or"), F.lit(0.0))) * (F.col("revenue_12m") / F.nullif(F.col("_or"), F.lit(0.0))))).alias("hhi"),
    ).join(med, "owner", "left")
    x, n = F.col, F.col("n")
    lim = lambda e, lo, hi: F.least(F.greatest(e, F.lit(float(lo))), F.lit(float(hi)))
    share = lambda a, b=n: x(a) / F.greatest(b, F.lit(1)) * 100
    s = {
        "absolute": 50 + F.when(x("rev") > 0, (lim(_log10("rev") * 20, 20, 100) - 50) * 0.5).otherwise(0.0)
        + F.when(x("prof") > 0, (lim(F.log10(F.greatest("prof", F.lit(0.0)) + 1) * 20, 20, 100) - 50) * 0.3).otherwise(0.0) + F.coalesce(lim(x("mg") * 100, -20, 50) * 0.2, F.lit(0.0)),
        "retention": 50 + (share("act") - 40) * 0.4 + F.least(share("old") * 0.3, F.lit(20.0)),
        "category": 50 + (share("multi") - 30) * 0.3 + F.least(_log10("multi") * 20, F.lit(30.0)) + F.least(share("has_new"), F.lit(30.0)) * 0.3 + F.least(F.coalesce("avg_new", F.lit(0.0)) * 1.5, F.lit(15.0)),
        "pricing": 50 + (F.lit(0.0) if losses is None else (100 - F.least(share("neg") * 2, F.lit(100.0))) * 0.2)
        + F.when(x("nk") > 0, (share("nk_high", x("nk")) - 30) * 0.25 + F.least(_log10("nk_high") * 15, F.lit(25.0))).otherwise(0.0) - F.least(F.coalesce("low", F.lit(0.0)), F.lit(50.0)) * 0.2,
        "acquisition": 50 + share("fresh") * 0.5 + (x("re1") * 0.5 + x("re2") * 0.3 + x("re3") * 1.0) / n * 100 * 0.5 + F.when(x("fresh") > 0, (share("fresh_good", x("fresh")) - 40) * 0.2).otherwise(0.0),
        "activation": 50 + F.when(x("s6") > 0, (share("s6_ok", x("s6")) - 20) * 0.5).otherwise(0.0),
        "upgrade": 50 + F.when(x("nk") > 0, F.least(x("nk_sa") * 2.5, F.lit(50.0)) + F.greatest(share("nk_sa", x("nk")) - 15, F.lit(0.0))).otherwise(0.0),
        "mix": 50 + F.least(_log10("high") * 30, F.lit(40.0)) + F.coalesce(F.least(F.greatest((x("mm") - 15) * 0.5, F.lit(0.0)), F.lit(20.0)), F.lit(0.0)),
        "diversification": F.when(x("rev") > 0, (1 - x("hhi")) * 100).otherwise(50.0),
    }
    g = g.withColumns({k: lim(v, 0, 100) for k, v in s.items()})
    g = g.withColumn("composite", sum(F.col(k) * w for k, w in PROFILE_WEIGHTS.items())).withColumns({
        "revenue_class": cases((x("rev") > 10_000_000, "heavy"), (x("rev") > 1_000_000, "middle"), default="light"),
        "subgroup": cases((n > 150, "batch"), (n > 50, "balanced"), default="key_customer"),
    })
    g = settle(g.select("owner", F.col("n").alias("customers"), "rev", "key_customers", *PROFILE_WEIGHTS, "composite", "revenue_class", "subgroup"))
    size = g.groupBy("revenue_class", "subgroup").agg(F.count("*").alias("_k"))
    g = pct_rank(g, ["revenue_class", "subgroup"], "composite", "_p").join(size, ["revenue_class", "subgroup"])
    r = F.col("_p") * 100
    grade = cases(
        (F.col("rev") > 80_000_000, "A"), (F.col("rev") <= 0, "D"), (F.col("_k") < 2, "B"), (r >= 70, "A"), (r >= 40, "B"), (r < 25, "D"), default="C"
    )
    return g.withColumn("grade", grade).drop("_p", "_k")


def capability_scores(profile: DataFrame) -> DataFrame:
    """The nine scores of each owner as rows, with the distance to the team's mean."""
    long = profile.select("owner", *PROFILE_WEIGHTS).unpivot(["owner"], list(PROFILE_WEIGHTS), "capability", "score")
    mean = long.groupBy("capability").agg(F.avg("score").alias("_m"))
    return long.join(mean, "capability").select("owner", "capability", "score", (F.col("score") - F.col("_m")).alias("gap"))


# --- association and cross-sell ------------------------------------------------------------------------------


def association_rules(rows: DataFrame, basket_cols, item: str, min_support: float = 0.02, min_confidence: float = 0.15, min_basket: int = 2) -> DataFrame:
    """Directed item pairs with support, confidence, lift, leverage and conviction over baskets of two or more items.

    Pairs are counted directly. Items under the support are dropped first: a frequent pair has two frequent items, and at most
    (mean basket size / support) items are frequent. Each item of a basket is joined to the basket's list, ordered by rarity,
    and paired with the less rare items after it, so a long basket is spread over as many rows as it has items, and counts are
    summed before the shuffle. Rows with a null basket column or item are left out; repeated items of a basket count once.
    """
    keys = [f"_b{i}" for i in range(len(basket_cols))]
    pairs = rows.select(*[F.col(c_).alias(k) for c_, k in zip(basket_cols, keys)], F.col(item).alias("i")).na.drop().distinct()
    baskets = pairs.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= min_basket).select(*keys)
    pairs = pairs.join(baskets, keys, "left_semi")
    total = baskets.agg(F.count("*")).scalar()
    counts = pairs.groupBy("i").agg(F.count("*").alias("n")).withColumn("t", total)
    often = F.col("n") >= F.col("t") * min_support
    kept = pairs.join(counts.filter(often).select("i", "n"), "i").select(*keys, F.struct("n", "i").alias("x"))
    lists = kept.groupBy(*keys).agg(F.collect_list("x").alias("items"))
    after = kept.join(lists, keys).select(F.col("x.i").alias("a"), F.explode(F.filter("items", lambda y: y > F.col("x"))).alias("y"))
    found = after.groupBy("a", F.col("y.i").alias("b")).agg(F.count("*").alias("n")).withColumn("t", total).filter(often)
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "t"))
    j = both.join(counts.select(F.col("i").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("i").alias("b"), F.col("n").alias("nb")), "b")
    t = dbl("t")
    sup, conf, sa, sb = F.col("n") / t, F.col("n") / F.col("na"), F.col("na") / t, F.col("nb") / t
    return j.filter(conf >= min_confidence).select(
        F.col("a").alias("item"), F.col("b").alias("with_item"), sup.alias("support"), conf.alias("confidence"), (conf / sb).alias("lift"), (sup - sa * sb).alias("leverage"),
        F.when(conf < 1, (1 - sb) / (1 - conf)).alias("conviction"), F.col("n").alias("baskets"),
    )


def gated_association(rows: DataFrame, basket_cols, item: str, min_rows: int = 100, **kw) -> DataFrame:
    """Association rules of customer, month and product rows; none where the input has fewer than `min_rows` rows."""
    enough = rows.agg(F.count("*") >= min_rows).scalar()
    return association_rules(rows, basket_cols, item, **kw).withColumn("_enough", enough).filter("_enough").drop("_enough")


def association_bonus(rules: DataFrame, factor: float = 5.0) -> DataFrame:
    return rules.select("item", "with_item", "confidence", (F.col("confidence") * factor).alias("bonus"))


PORTRAIT_BONUS = {"growth": 5, "cash_cow": 4, "new_watch": 3, "warning_growth": 2, "hidden_decline": 0, "decline": -1}


def recommendation_scores(cpm: DataFrame, portraits: DataFrame | None = None, aging: DataFrame | None = None, dead_share: float = 0.15, dead_bonus: float = 3.0) -> DataFrame:
    """Product score: popularity x 10, portrait bonus, dead-stock bonus."""
    pop = cpm.groupBy("product_id").agg(F.count_distinct("customer_id").alias("buyers"))
    top = pop.agg(F.max("buyers").alias("m")).scalar()
    s = pop.withColumn("popularity", div("buyers", top))
    s = s.join(portraits.select("product_id", "portrait"), "product_id", "left") if portraits is not None else s.withColumn("portrait", F.lit(None).cast("string"))
    if aging is not None:
        s = s.join(aging.select("product_id", "over_1y_share", "over_1y"), "product_id", "left")
        dead = F.coalesce((F.col("over_1y_share") > dead_share) & (F.col("over_1y") > 0), F.lit(False))
    else:
        dead = F.lit(False)
    bonus = cases(*[(F.col("portrait") == k, float(v)) for k, v in PORTRAIT_BONUS.items()], default=0.0)
    return s.select("product_id", "buyers", "popularity", "portrait", dead.alias("dead_stock"), (F.col("popularity") * 10 + bonus + F.when(dead, dead_bonus).otherwise(0.0)).alias("score"))


def cross_sell(cpm: DataFrame, scores: DataFrame, rules: DataFrame, group: str = "product_line", k: int = 5, group_bonus: float = 3.0) -> DataFrame:
    """Best k products a customer has not bought: dead stock first, then score + same-line bonus + association bonus.

    No customer x product cross product. A product without an association to the customer ranks by the line's own
    order, so only the first k gaps in each bought line's ranking, and of the company ranking, can be chosen: they
    are read off the bought ranks. Products with an association come from a join on the rules.
    """
    products = cpm.groupBy("product_id").agg(F.max(group).alias("grp"))
    s = scores.select("product_id", "score", "dead_stock", "portrait").join(products, "product_id")
    order = [F.desc("dead_stock"), F.desc("score"), F.asc("product_id")]
    s = settle(_ranks(s, order))
    bought = settle(cpm.select("customer_id", "product_id").distinct().join(s.select("product_id", "grp", "g_rank", "a_rank"), "product_id"))
    in_line = _gaps(bought, ["customer_id", "grp"], "g_rank", k).join(s.select("grp", F.col("g_rank").alias("rank"), "product_id"), ["grp", "rank"])
    # Company-wide gaps may fall in a bought line; those keep their bonus below, so nothing better is missed.
    anywhere = _gaps(bought, ["customer_id"], "a_rank", k).join(s.select(F.col("a_rank").alias("rank"), "product_id"), "rank")
    linked = (
        bought.select("customer_id", F.col("product_id").alias("item")).join(association_bonus(rules), "item")
        .groupBy("customer_id", F.col("with_item").alias("product_id")).agg(F.sum("bonus").alias("bonus"), F.max("confidence").alias("confidence"))
        .join(bought.select("customer_id", "product_id"), ["customer_id", "product_id"], "left_anti")
    )
    cand = in_line.select("customer_id", "product_id").union(anywhere.select("customer_id", "product_id")).union(linked.select("customer_id", "product_id")).distinct()
    lines = bought.select("customer_id", "grp").distinct().withColumn("same_line", F.lit(True))
    c = cand.join(s, "product_id").join(lines, ["customer_id", "grp"], "left").join(linked, ["customer_id", "product_id"], "left")
    total = F.col("score") + F.when(F.col("same_line"), group_bonus).otherwise(0.0) + F.coalesce("bonus", F.lit(0.0))
    c = c.withColumn("total", total)
    best = top_k(c, ["customer_id"], [F.desc("dead_stock"), F.desc("total"), F.asc("product_id")], k)
    reason = F.concat_ws(
        "; ", F.when(F.col("same_line"), F.concat(F.lit("same line "), "grp")), F.when(F.col("bonus").isNotNull(), "bought together"),
        F.when(F.col("same_line").isNull() & F.col("bonus").isNull(), F.coalesce(F.concat(F.lit("portrait "), "portrait"), F.lit("popular"))),
    )
    return best.select("customer_id", "rank", "product_id", "dead_stock", F.col("total").alias("score"), reason.alias("reason"))


def _ranks(s: DataFrame, order) -> DataFrame:
    """Rank of each product in its group and in the company, both by the distributed running sum."""
    from ..functions.distribution import running

    s = s.withColumns({"_d": F.when(F.col("dead_stock"), 0).otherwise(1), "_s": -F.col("score")})
    a = running(s, ["grp"], ["_d", "_s", "product_id"], {"g": F.lit(1)})
    b = running(a, [], ["_d", "_s", "product_id"], {"a": F.lit(1)})
    return b.select("product_id", "score", "dead_stock", "portrait", "grp", (F.col("g_before") + 1).alias("g_rank"), (F.col("a_before") + 1).alias("a_rank"), F.col("g_total"), F.col("a_total"))


def _gaps(bought: DataFrame, keys, rank: str, k: int) -> DataFrame:
    """First k ranks missing from each key's set of ranks (ranks past the end of the list simply do not join)."""
    w = Window.partitionBy(*keys).orderBy(rank)
    t = bought.select(*keys, F.col(rank).alias("r"), F.coalesce(F.lag(rank).over(w), F.lit(0)).alias("prev"), (F.col(rank) - F.row_number().over(w)).alias("missing"), F.lead(rank).over(w).isNull().alias("last"))
    before = F.col("missing") - (F.col("r") - F.col("prev") - 1)
    inner = t.filter((F.col("r") - F.col("prev") > 1) & (before < k)).select(*keys, F.explode(F.sequence(F.col("prev") + 1, F.least(F.col("r") - 1, F.col("prev") + k - before))).alias("rank"))
    tail = t.filter(F.col("last") & (F.col("missing") < k)).select(*keys, F.explode(F.sequence(F.col("r") + 1, F.col("r") + k - F.col("missing"))).alias("rank"))
    return inner.unionByName(tail)


# --- two-window bridges --------------------------------------------------------------------------------------


def profit_bridge(fact: DataFrame, latest: int, months: int = 12, net: bool = False) -> DataFrame:
    """Profit change between two windows from comparable products: volume, price, cost, mix and the rest.

    `net` keeps returns in the quantities and compares only products with positive net quantity in both windows.
    """
    a, b = within(latest, months), within(latest, months, months)
    rows = fact if net else fact.filter(F.col("qty") > 0)
    g = rows.filter(a | b).groupBy("product_id").agg(
        *[total_if(w, m).alias(f"{m}_{n}") for n, w in (("1", a), ("0", b)) for m in ("qty", "revenue", "cost", "profit")]
    )
    ok = (F.col("qty_1") > 0) & (F.col("qty_0") > 0) & (F.col("revenue_1") > 0) & (F.col("revenue_0") > 0)
    p1, p0 = (F.col(f"revenue_{i}") / F.nullif(F.col(f"qty_{i}"), F.lit(0.0)) for i in "10")
    c1, c0 = (F.col(f"cost_{i}") / F.nullif(F.col(f"qty_{i}"), F.lit(0.0)) for i in "10")
    when = lambda e: F.coalesce(F.sum(F.when(ok, e)), F.lit(0.0))
    t = g.agg(
        when(F.col("qty_1")).alias("q1"), when(F.col("qty_0")).alias("q0"), when(F.col("profit_0")).alias("m0"), when(F.col("profit_1")).alias("m1"),
        when((p1 - p0) * F.col("qty_1")).alias("price_effect"), when((c0 - c1) * F.col("qty_1")).alias("cost_effect"), F.sum("profit_1").alias("profit_now"), F.sum("profit_0").alias("profit_before"),
        count_if(ok).alias("comparable_products"),
    )
    vol = (F.col("q1") - F.col("q0")) * F.col("m0") / F.nullif(F.col("q0"), F.lit(0.0))
    mix = F.col("m1") - F.col("m0") - vol - F.col("price_effect") - F.col("cost_effect")
    return t.select(
        "comparable_products", "profit_before", "profit_now", vol.alias("volume_effect"), "price_effect", "cost_effect", mix.alias("mix_effect"),
        (F.col("profit_now") - F.col("profit_before") - (F.col("m1") - F.col("m0"))).alias("other_products"),
    )


def owner_sku_mix(fact: DataFrame, latest: int, months: int = 12, band: float = 0.05) -> DataFrame:
    """Owner's revenue by product class: star, regular or hook against the company margin +-5 points."""
    r = fact.filter(within(latest, months))
    company = r.agg(div(F.sum("profit"), F.sum("revenue")).alias("m")).scalar()
    g = r.groupBy("owner", "product_id").agg(F.sum("revenue").alias("r"), F.sum("profit").alias("p")).withColumn("m", div("p", "r")).withColumn("c", company)
    cls = cases((F.col("m") > F.col("c") + band, "star"), (F.col("m") < F.col("c") - band, "hook"), default="regular")
    return g.withColumn("cls", cls).groupBy("owner").agg(
        dbl(F.sum("r")).alias("revenue"), *[total_if(F.col("cls") == x, "r").alias(f"{x}_revenue") for x in ("star", "regular", "hook")], *[count_if(F.col("cls") == x).alias(f"{x}_products") for x in ("star", "regular", "hook")]
    )
