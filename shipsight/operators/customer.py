"""Customer metrics that make up the customer portrait.

Windows by customer run over monthly rows, so a group is bounded by the calendar, not by the data volume.
Rankings of products inside a customer use `row_number() <= k`, which Spark prunes before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import (
    cases, clip, count_if, dbl, div, left_join_all, mean, mean_if, top_k, total_if, within,
)

DAYS_PER_MONTH = 30.4375


def purchase_interval(cm: DataFrame, skip_months: int = 6) -> DataFrame:
    """Mean day gap between active months after the customer's first `skip_months` months."""
    w = Window.partitionBy("customer_id")
    late = cm.withColumn("_first", F.min("month_idx").over(w)).filter(F.col("month_idx") >= F.col("_first") + skip_months)
    gap = F.datediff("month", F.lag("month").over(w.orderBy("month_idx")))
    g = late.select("customer_id", gap.alias("g")).groupBy("customer_id").agg(mean("g").alias("interval_days"))
    return cm.select("customer_id").distinct().join(g, "customer_id", "left")


def churn_warning(cm: DataFrame, intervals: DataFrame, latest: int, multiplier: float = 1.5, days_per_month=DAYS_PER_MONTH) -> DataFrame:
    last = cm.groupBy("customer_id").agg(
        ((F.lit(latest) - F.max("month_idx")) * F.lit(days_per_month)).alias("days_since")
    )
    late = F.col("days_since") > F.col("interval_days") * multiplier
    return intervals.join(last, "customer_id", "left").withColumn("interrupted", F.coalesce(late, F.lit(False)))


def top_share(df: DataFrame, key: str, item: str, k: int, grain: str = "item", value: str = "revenue") -> DataFrame:
    """Revenue of the k largest items (or single rows) per key over the key's total."""
    rows = df.groupBy(key, item).agg(F.sum(value).alias("_v")) if grain == "item" else df.withColumn("_v", F.col(value))
    order = [F.desc("_v"), F.asc(item)] + ([F.asc("month_idx")] if grain == "row" else [])
    top = top_k(rows, [key], order, k).groupBy(key).agg(F.sum("_v").alias("_top"))
    tot = df.groupBy(key).agg(F.sum(value).alias("_tot"))
    share = F.when(F.col("_tot") > 0, div("_top", "_tot")).otherwise(F.lit(0.0))
    return tot.join(top, key, "left").select(key, dbl("_tot").alias("total"), share.alias("share"))


def product_concentration(cpm: DataFrame, k: int = 5, threshold: float = 0.7, grain: str = "row") -> DataFrame:
    s = top_share(cpm, "customer_id", "product_id", k, grain)
    return s.select(
        "customer_id",
        F.col("total").alias("revenue_total"),
        F.col("share").alias("top_share"),
        (F.col("share") > threshold).alias("dependent"),
    )


def hhi(shares) -> F.Column:
    """Sum of squared positive shares."""
    return F.sum(F.when(shares > 0, shares * shares))


def main_group(df: DataFrame, key: str, group: str, prefix: str) -> DataFrame:
    """Largest group of each key and its share; groups with the same revenue go to the smaller label."""
    g = df.filter(F.col(group).isNotNull()).groupBy(key, group).agg(F.sum("revenue").alias("_v"))
    best = top_k(g, [key], [F.desc("_v"), F.asc(group)], 1, "_r")
    tot = df.groupBy(key).agg(F.sum("revenue").alias("_t"))
    return best.join(tot, key).select(
        key, F.col(group).alias(prefix), div("_v", "_t").alias(f"{prefix}_share")
    )


def category_acceptance(
    cpm: DataFrame, group: str = "category", dominant: float = 0.60, penetration: float = 0.10
) -> DataFrame:
    """Dominant category of each customer and the widely bought categories it has never bought.

    Categories above the penetration share are fewer than 1 / penetration, so they travel as one small array.
    """
    by_cat = cpm.groupBy(group).agg(F.sum("revenue").alias("v"))
    total = cpm.agg(F.sum("revenue").alias("t")).scalar()
    wide = (
        by_cat.filter(div("v", total) > penetration).agg(F.array_sort(F.collect_set(group)).alias("a")).scalar()
    )
    bought = (
        cpm.filter(F.array_contains(wide, F.col(group))).groupBy("customer_id").agg(F.collect_set(group).alias("b"))
    )
    out = main_group(cpm, "customer_id", group, "main_category").join(bought, "customer_id", "left")
    missing = F.array_except(wide, F.coalesce("b", F.array().cast("array<string>")))
    return out.select(
        "customer_id",
        "main_category",
        "main_category_share",
        F.array_join(missing, "; ").alias("unopened"),
        cases(
            (F.size(missing) > 0, "watch_unopened"),
            (F.col("main_category_share") > dominant, "same_category_first"),
            default="regular",
        ).alias("category_label"),
    )


def _trailing_months(df: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Up and down streaks at the newest end of each monthly series (first break from the end)."""
    w = Window.partitionBy(key)
    prev = F.lag(value).over(w.orderBy("month_idx"))
    up = F.coalesce(dbl(value) > dbl(prev) * tolerance, F.lit(False))
    down = F.coalesce(~up & (F.col(value) < prev), F.lit(False))
    back = F.row_number().over(w.orderBy(F.desc("month_idx"))) - 1
    t = df.select(key, up.alias("_u"), down.alias("_d"), back.alias("_b"))
    return t.groupBy(key).agg(
        F.min(F.when(~F.col("_u"), F.col("_b"))).alias("streak_up"),
        F.min(F.when(~F.col("_d"), F.col("_b"))).alias("streak_down"),
    )


def streaks(cm: DataFrame, latest: int, window: int = 12, tolerance: float = 0.95) -> DataFrame:
    t = _trailing_months(cm.filter(within(latest, window)), "customer_id", "revenue", tolerance)
    return cm.select("customer_id").distinct().join(t, "customer_id", "left").na.fill(0, ["streak_up", "streak_down"])


def momentum(cm: DataFrame, latest: int, window: int = 12, short: int = 6, lo: float = -1.0, hi: float = 5.0) -> DataFrame:
    """12-month value, growth of the mean positive month (6-month fallback), year-on-year, ASP: one scan."""
    now, before = within(latest, window), within(latest, window, window)
    now_s, before_s = within(latest, short), within(latest, short, short)
    pos = F.col("revenue") > 0
    g = cm.groupBy("customer_id").agg(
        total_if(now, "revenue").alias("revenue_12m"),
        total_if(now, "profit").alias("profit_12m"),
        total_if(now, "qty").alias("qty_12m"),
        total_if(before, "revenue").alias("revenue_prior_12m"),
        total_if(before, "profit").alias("profit_prior_12m"),
        F.coalesce(F.sum(F.when(now, F.col("orders"))), F.lit(0)).alias("orders_12m"),
        mean_if(now & pos, "revenue").alias("_rm"),
        mean_if(before & pos, "revenue").alias("_pm"),
        count_if(before & pos).alias("_pc"),
        mean_if(now_s & pos, "revenue").alias("_rs"),
        mean_if(before_s & pos, "revenue").alias("_ps"),
    )
    main = F.when(F.col("_pc") >= 2, (F.col("_rm") - F.col("_pm")) / F.col("_pm"))
    short_g = (F.coalesce("_rs", F.lit(0.0)) - F.col("_ps")) / F.col("_ps")
    growth = F.when(F.col("_pc") >= 2, F.coalesce(main, F.lit(lo))).otherwise(F.coalesce(short_g, F.lit(0.0)))
    yoy = F.when(F.col("_pc") >= 2, (F.coalesce("_rm", F.lit(0.0)) - F.col("_pm")) / F.col("_pm")).otherwise(F.lit(0.0))
    pct = F.when(F.col("revenue_12m") > 0, F.col("profit_12m") / F.nullif(F.col("revenue_12m"), F.lit(0.0)) * 100)
    asp = F.when(F.col("qty_12m") > 0, F.col("revenue_12m") / F.nullif(F.col("qty_12m"), F.lit(0.0)))
    return g.select(
        "customer_id", "revenue_12m", "profit_12m", "qty_12m", "revenue_prior_12m", "profit_prior_12m", "orders_12m",
        F.coalesce(pct, F.lit(0.0)).alias("margin_12m"),
        clip(growth, lo, hi).alias("growth"),
        F.coalesce(asp, F.lit(0.0)).alias("asp"),
        yoy.alias("yoy"),
    )


def product_coverage(cpm: DataFrame, k: int = 3) -> DataFrame:
    n = cpm.groupBy("customer_id").agg(F.count_distinct("product_id").alias("products"))
    first = top_share(cpm, "customer_id", "product_id", 1).select("customer_id", F.col("share").alias("top1_share"))
    best = top_share(cpm, "customer_id", "product_id", k).select("customer_id", F.col("share").alias(f"top{k}_share"))
    return n.join(first, "customer_id").join(best, "customer_id")


def line_distribution(cpm: DataFrame) -> DataFrame:
    """Lines bought, main line and share, concentration of lines, categories bought."""
    g = cpm.groupBy("customer_id", "product_line").agg(F.sum("revenue").alias("v"))
    tot = cpm.groupBy("customer_id").agg(
        F.sum("revenue").alias("t"), F.count_distinct("category").alias("categories")
    )
    share = div("v", "t")
    stats = g.join(tot, "customer_id").groupBy("customer_id").agg(
        F.max("t").alias("t"),
        F.max("categories").alias("categories"),
        F.count("*").alias("_n"),
        hhi(share).alias("_h"),
    )
    main = main_group(cpm, "customer_id", "product_line", "main_line")
    ok = F.col("t") > 0
    return stats.join(main, "customer_id", "left").select(
        "customer_id",
        "categories",
        F.when(ok, F.col("_n")).otherwise(F.lit(0)).alias("lines"),
        F.when(ok, F.col("main_line")).otherwise("none").alias("main_line"),
        F.when(ok, F.col("main_line_share")).otherwise(0.0).alias("main_line_share"),
        F.when(ok, F.col("_h")).otherwise(1.0).alias("line_hhi"),
    )


def sku_lifecycle(
    pm: DataFrame, latest: int, intro_months: int = 3, intro_qty: float = 1000, exit_ratio: float = 0.3,
    decline_ratio: float = 0.7, growth: float = 0.15, mature_months: int = 6,
) -> DataFrame:
    """Product stage by precedence: intro, exit, hidden decline, growth, mature, else intro."""
    act = pm.filter((F.col("revenue") > 0) | (F.col("qty") > 0))
    w = Window.partitionBy("product_id")
    prev = F.lag("revenue").over(w.orderBy("month_idx"))
    t = act.select(
        "product_id", "month_idx", "revenue", "qty",
        (prev > F.col("revenue")).alias("fell"),
        F.row_number().over(w.orderBy(F.desc("month_idx"))).alias("back"),
    )
    now, before = within(latest, 3), within(latest, 3, 3)
    g = t.groupBy("product_id").agg(
        F.count("*").alias("n"),
        dbl(F.sum("qty")).alias("q"),
        dbl(F.sum("revenue")).alias("r"),
        dbl(F.max("revenue")).alias("peak"),
        count_if(F.col("fell") & (F.col("back") <= 5)).alias("falls"),
        total_if(now, "revenue").alias("l3"),
        total_if(before, "revenue").alias("p3"),
        F.coalesce(mean_if(now, "revenue"), F.lit(0.0)).alias("ra"),
        F.coalesce(mean_if(before, "revenue"), F.lit(0.0)).alias("pa"),
    )
    half = (F.col("n") >= 3) & (F.col("falls") >= 3)
    stage = cases(
        ((F.col("n") <= intro_months) & (F.col("q") < intro_qty), "intro"),
        (half & (F.col("l3") < F.col("peak") * exit_ratio) & (F.col("r") > 0), "exit"),
        (half & (F.col("l3") > 0) & (F.col("p3") > 0) & (F.col("l3") < F.col("p3") * decline_ratio), "hidden_decline"),
        ((F.col("pa") > 0) & ((F.col("ra") - F.col("pa")) > growth * F.col("pa")), "growth"),
        (F.col("n") >= mature_months, "mature"),
        default="intro",
    )
    staged = g.select("product_id", stage.alias("sku_stage"))
    return (
        pm.select("product_id").distinct().join(staged, "product_id", "left").na.fill("intro", ["sku_stage"])
    )


def customer_lifecycle(
    cm: DataFrame, latest: int, lost: int = 18, sleep: int = 6, intro: int = 12, ramp: float = 0.05,
    ramp_window: int = 3, decline: float = 0.15, expected_months: int = 18,
) -> DataFrame:
    """Customer stage by precedence, with confidence by months covered."""
    w = Window.partitionBy("customer_id")
    r12 = within(latest, 12)
    t = cm.select(
        "customer_id", "month_idx", "revenue",
        F.row_number().over(w.orderBy(F.desc("month_idx"))).alias("back"),
        div(F.sum(F.when(r12, F.col("revenue"))).over(w), F.count(F.when(r12, F.lit(1))).over(w)).alias("avg12"),
    )
    low = F.coalesce(dbl("revenue") < F.col("avg12") * (1 - decline), F.lit(False))
    g = t.groupBy("customer_id").agg(
        (F.lit(latest) - F.max("month_idx")).alias("since"),
        (F.lit(latest) - F.min("month_idx")).alias("age"),
        F.count("*").alias("coverage_months"),
        F.max("avg12").alias("avg12"),
        F.bool_and(F.when(F.col("back") <= 3, low)).alias("low3"),
        F.coalesce(mean_if(within(latest, ramp_window), "revenue"), F.lit(0.0)).alias("ra"),
        F.coalesce(mean_if(within(latest, ramp_window, ramp_window), "revenue"), F.lit(0.0)).alias("pa"),
    )
    stage = cases(
        (F.col("since") >= lost, "lost"),
        (F.col("since") >= sleep, "sleep"),
        (F.col("age") <= intro, "intro"),
        ((F.col("pa") > 0) & (F.col("ra") - F.col("pa") > ramp * F.col("pa")), "ramp"),
        (F.col("low3") & (F.col("coverage_months") >= 3) & (F.col("avg12") > 0), "decline"),
        default="mature",
    )
    conf = cases(
        (F.col("coverage_months") < 6, "low"), (F.col("coverage_months") < expected_months, "medium"), default="high"
    )
    return g.select("customer_id", stage.alias("lifecycle"), "coverage_months", conf.alias("lifecycle_confidence"))


def new_product_cohort(pm: DataFrame, cpm: DataFrame, latest: int, months: int = 12) -> DataFrame:
    """Purchases of products flagged new inside the window, per customer, with global penetration."""
    new = pm.filter(within(latest, months)).groupBy("product_id").agg(F.bool_or("is_new").alias("n")).filter("n")
    tot = cpm.groupBy("customer_id").agg(F.sum("revenue").alias("_t"))
    bought = (
        cpm.join(new.select("product_id"), "product_id", "left_semi")
        .groupBy("customer_id")
        .agg(dbl(F.sum("revenue")).alias("new_revenue"), F.count_distinct("product_id").alias("new_products"))
    )
    r = tot.join(bought, "customer_id", "left").select(
        "customer_id",
        F.coalesce("new_revenue", F.lit(0.0)).alias("new_revenue"),
        F.coalesce("new_products", F.lit(0)).alias("new_products"),
        div(F.coalesce("new_revenue", F.lit(0.0)), "_t").alias("new_share"),
        (F.coalesce("new_revenue", F.lit(0.0)) > 0).alias("buys_new"),
    )
    rate = r.agg(div(F.count(F.when(F.col("buys_new"), 1)), F.count("*")).alias("p")).scalar()
    return r.withColumn("new_penetration", rate)


def opportunity_signals(cm: DataFrame, pm: DataFrame, cpm: DataFrame, latest: int, months: int = 12) -> DataFrame:
    """Share of recently launched products the customer bought in 12 months, and 3-month momentum."""
    new = pm.groupBy("product_id").agg(F.min("month_idx").alias("f")).filter(F.col("f") >= latest - months)
    n_new = new.agg(F.count("*").alias("n")).scalar()
    pen = (
        cpm.filter(within(latest, 12))
        .join(new.select("product_id"), "product_id", "left_semi")
        .groupBy("customer_id")
        .agg(F.count_distinct("product_id").alias("k"))
    )
    g = cm.groupBy("customer_id").agg(
        F.coalesce(mean_if(within(latest, 3), "revenue"), F.lit(0.0)).alias("ra"),
        F.coalesce(mean_if(within(latest, 3, 3), "revenue"), F.lit(0.0)).alias("pa"),
    )
    rise = F.when(F.col("pa") > 0, (F.col("ra") - F.col("pa")) / F.nullif(F.col("pa"), F.lit(0.0))).otherwise(0.0)
    return g.join(pen, "customer_id", "left").select(
        "customer_id", F.coalesce(div("k", n_new), F.lit(0.0)).alias("new_reach"), rise.alias("momentum")
    )


def risk_signals(cm: DataFrame, cpm: DataFrame, latest: int) -> DataFrame:
    """12-month revenue share of products not bought in the last 3 months; drop of the last 3 observed months."""
    pairs = cpm.filter(within(latest, 12)).groupBy("customer_id", "product_id").agg(
        F.sum("revenue").alias("r"), F.max("month_idx").alias("last")
    )
    lost = pairs.groupBy("customer_id").agg(
        F.sum(F.when(F.col("last") <= latest - 3, F.col("r"))).alias("l"), F.sum("r").alias("t")
    )
    w = Window.partitionBy("customer_id")
    t = cm.select(
        "customer_id", "revenue",
        F.row_number().over(w.orderBy(F.desc("month_idx"))).alias("back"),
    )
    g = t.groupBy("customer_id").agg(
        total_if(F.col("back") <= 3, "revenue").alias("r3"), total_if(F.col("back").between(4, 6), "revenue").alias("p3")
    )
    drop = F.when(F.col("p3") > 0, (F.col("p3") - F.col("r3")) / F.nullif(F.col("p3"), F.lit(0.0))).otherwise(0.0)
    return g.join(lost, "customer_id", "left").select(
        "customer_id",
        F.when(F.col("t") > 0, F.coalesce(div("l", "t"), F.lit(0.0))).otherwise(0.0).alias("lost_share"),
        drop.alias("half_year_drop"),
    )


def main_sku_stage(cpm: DataFrame, stages: DataFrame) -> DataFrame:
    n = (
        cpm.select("customer_id", "product_id").distinct().join(stages, "product_id")
        .groupBy("customer_id", "sku_stage").agg(F.count("*").alias("n"))
    )
    return top_k(n, ["customer_id"], [F.desc("n"), F.asc("sku_stage")], 1).select(
        "customer_id", F.col("sku_stage").alias("main_sku_stage")
    )


def asp_gap(mom: DataFrame, pm: DataFrame, latest: int, cap: float = 100.0) -> DataFrame:
    """Percent gap of the customer's ASP to the company's 12-month ASP."""
    r = within(latest, 12)
    company = pm.filter(r).agg(div(F.sum("revenue"), F.sum("qty")).alias("p")).scalar()
    return mom.select("customer_id", clip((F.col("asp") - company) / company * 100, -cap, cap).alias("asp_gap_pct"))


def margin_change(mom: DataFrame) -> DataFrame:
    before = div("profit_prior_12m", "revenue_prior_12m")
    ok = (F.col("revenue_prior_12m") > 0) & (before > 0)
    return mom.select(
        "customer_id",
        F.when(ok, (F.col("margin_12m") / 100 - before) / before * 100).otherwise(0.0).alias("margin_change_pct"),
    )


def base_info(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id",
        *[F.coalesce(a, F.lit("unknown")).alias(a) for a in ("channel", "tier", "region", "owner")],
    )


def portrait(w, pricing) -> DataFrame:
    """One wide row per customer: every customer metric joined on the customer key."""
    cm, pm = w.customer_month(), w.product_month()
    cpm = w.customer_product_month(extra=("product_line", "category"))
    lt = w.latest
    mom = momentum(cm, lt)
    parts = [
        streaks(cm, lt),
        product_coverage(cpm),
        line_distribution(cpm),
        churn_warning(cm, purchase_interval(cm), lt),
        product_concentration(cpm).withColumnRenamed("top_share", "top5_share"),
        pricing.price_bands(cpm).select("customer_id", "low_share", "mid_share", "high_share"),
        category_acceptance(cpm).drop("unopened"),
        customer_lifecycle(cm, lt),
        new_product_cohort(pm, cpm, lt),
        opportunity_signals(cm, pm, cpm, lt),
        risk_signals(cm, cpm, lt),
        main_sku_stage(cpm, sku_lifecycle(pm, lt)),
        asp_gap(mom, pm, lt),
        margin_change(mom),
    ]
    return left_join_all(mom.join(base_info(w.customers()), "customer_id", "left"), parts, "customer_id")


def top_n_concentration(fact: DataFrame, key: str, item: str, n: int) -> DataFrame:
    """Top-1 and top-n revenue share of the items in each key; the top-n share is 1 with fewer than n items."""
    g = fact.groupBy(key, item).agg(F.sum("revenue").alias("v"))
    t = g.groupBy(key).agg(F.sum("v").alias("t"), F.count("*").alias("k"))
    best = top_k(g, [key], [F.desc("v"), F.asc(item)], n).groupBy(key).agg(
        F.sum("v").alias("tn"), F.sum(F.when(F.col("rank") == 1, F.col("v"))).alias("t1")
    )
    return t.join(best, key).select(
        key,
        F.when(F.col("k") < n, 1.0).otherwise(F.coalesce(div("tn", "t"), F.lit(0.0))).alias(f"top{n}_share"),
        F.coalesce(div("t1", "t"), F.lit(0.0)).alias("top1_share"),
    )


def group_hhi(fact: DataFrame, key: str, item: str) -> DataFrame:
    g = fact.groupBy(key, item).agg(F.sum("revenue").alias("v"))
    t = g.groupBy(key).agg(F.sum("v").alias("t"))
    return g.join(t, key).groupBy(key).agg(hhi(div("v", "t")).alias("hhi"))
