"""Action advice and strategy rules over the scored portrait."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import cases, count_if, dbl, total_if
from ..functions.distribution import one_row, quantiles
from ..functions.settle import settle

PERCENTILE_COLUMNS = ("profit_12m", "revenue_12m", "growing_score", "categories", "revenue_cv", "new_share")
PERCENTILES = (15, 20, 25, 30, 50, 65, 70, 75, 80)


def simple_actions(p: DataFrame) -> DataFrame:
    """Up to eight pieces of advice per customer, joined, with their number."""
    x = F.col
    items = [
        ((x("new_share") < 0.05) & (x("products") > 0), "introduce new products"), (x("new_share") > 0.2, "expand new products"), (x("interrupted"), "unusual purchase interval: call back"),
        (x("dependent"), "too concentrated: widen the range"), (x("lifecycle").isin("decline", "sleep", "lost"), "start recovery or limit credit"), (x("lost_share") > 0.15, "key products lost: ask for the substitute"),
        (x("low_share") > 0.5, "mostly low-price products: room to raise"), (x("main_sku_stage") == "exit", "migrate from exit products"),
    ]
    text = F.concat_ws("; ", *[F.when(c_, F.lit(t)) for c_, t in items])
    n = sum(F.when(c_, 1).otherwise(0) for c_, _ in items)
    return p.select("customer_id", F.coalesce(F.nullif(text, F.lit("")), F.lit("no action")).alias("actions"), n.cast("int").alias("action_count"))


def active_percentiles(p: DataFrame, cols=PERCENTILE_COLUMNS, probs=PERCENTILES) -> DataFrame:
    """Exact percentiles of several columns over active customers, one row per column."""
    act = p.filter(F.col("revenue_12m") > 0).select("customer_id", *[dbl(c_).alias(c_) for c_ in cols])
    return quantiles(act.unpivot(["customer_id"], list(cols), "measure", "v"), ["measure"], "v", {f"p{n}": n / 100 for n in probs})


def trading_months(cm: DataFrame) -> DataFrame:
    return cm.filter(F.col("revenue") > 0).groupBy("customer_id").agg(F.count_distinct("month_idx").alias("trading_months"))


def strategies(p: DataFrame, cm: DataFrame, declines: DataFrame) -> DataFrame:
    """First matching strategy by precedence: dormant, risk control, reactivation, binding, growth, category, upkeep, silent."""
    q = active_percentiles(p)
    pick = [("profit_12m", 15), ("profit_12m", 50), ("profit_12m", 70), ("revenue_12m", 20), ("revenue_12m", 50), ("growing_score", 50), ("growing_score", 65), ("growing_score", 70), ("categories", 50), ("categories", 75)]
    row = one_row(q.agg(*[F.coalesce(F.max(F.when(F.col("measure") == m, F.col(f"p{n}"))), F.lit(0.0)).alias(f"{m}_{n}") for m, n in pick]))
    d = declines.groupBy("customer_id").agg(F.sum("loss").alias("decline_loss"))
    t = settle(p.join(trading_months(cm), "customer_id", "left").join(d, "customer_id", "left").na.fill(0, ["trading_months"]).withColumn("_q", row))
    x = F.col
    m, n = lambda c_, k: F.col(f"_q.{c_}_{k}"), lambda c_: F.coalesce(F.col(c_), F.lit(0.0))
    ka = x("tier").isin("KA", "AA")
    gap = F.coalesce("interval_days", F.lit(60.0))
    falling = (x("journey") == "decline") | (x("lifecycle") == "decline")
    cum = F.when(x("revenue_12m") > 0, n("decline_loss") / F.nullif(x("revenue_12m"), F.lit(0.0))).otherwise(0.0)
    rev_ok = x("revenue_12m") >= m("revenue_12m", 50)
    severe = (falling & (x("streak_down") >= 3) & (cum >= 0.3)) | ((x("true_margin") <= 0) & rev_ok & (x("streak_down") >= 2)) | ((x("top3_share") >= 0.95) & rev_ok & (x("streak_down") >= 3))
    cv_limit = cases((ka, 4.0), (x("tier") == "KM", 3.5), default=5.0)
    late = lambda k: x("interrupted") | ((gap > 0) & (n("days_since") > gap * k))
    medium = (x("streak_down") >= 3) | ((x("zero_share") >= 0.9) & (x("revenue_cv") >= cv_limit)) | (late(2.0) & rev_ok & (x("journey") != "lost"))
    high = x("profit_12m") >= m("profit_12m", 50)
    s5 = cases((x("profit_12m") < m("profit_12m", 15), F.lit(None).cast("string")), (high & severe, "severe"), (high & medium, "medium"), (high & late(1.5), "light"), (~high & severe, "severe"), default=F.lit(None).cast("string"))
    s5 = F.when(s5.isNotNull() & x("value_tier").isin("S", "A") & ~ka, "watch_upgrade").otherwise(s5)
    down = x("lifecycle").isin("decline", "lost") | x("journey").isin("decline", "lost")
    dormant6 = x("journey").isin("lost", "reactivated") | x("lifecycle").isin("sleep", "lost") | ((n("days_since") > 180) & (x("revenue_prior_12m") >= 20_000))
    s6 = ~(x("value_tier").isin("S", "A") & (x("revenue_12m") > 0)) & dormant6 & (x("revenue_prior_12m") >= 20_000)
    bonus = sum(F.when(c_, 1).otherwise(0) for c_ in (x("growing_score") >= m("growing_score", 50), (x("categories") >= m("categories", 75)) & (m("categories", 75) > 0), x("top3_share") < 0.6, x("journey") == "mature"))
    s1 = x("value_tier").isin("S", "A") & (x("trading_months") >= 12) & (x("profit_12m") >= F.when(ka, m("profit_12m", 50)).otherwise(m("profit_12m", 70)))
    g70 = x("growing_score") >= m("growing_score", 70)
    s3 = (x("top3_share") < 0.95) & ~down & (x("trading_months") >= 3) & (
        (x("streak_up") >= 3) | (x("value_tier").isin("B", "C") & g70) | ((n("new_share") > 0.15) & (x("revenue_12m") >= m("revenue_12m", 20))) | ((x("growth") > 0.1) & g70) | ((x("journey") == "growth") & (x("growing_score") >= m("growing_score", 65)))
    )
    s4 = ~down & (x("streak_down") < 2) & ~((x("categories") >= m("categories", 50)) & (m("categories", 50) > 0)) & x("category_label").isNotNull() & (x("revenue_12m") >= 5_000) & ((x("trading_months") >= 3) | x("value_tier").isin("A", "B"))
    t = t.withColumns({"risk_control_level": s5, "bonuses": bonus})
    name = cases(
        ((x("activity") == "inactive") | (x("value_tier") == "dormant"), "dormant"), (x("risk_control_level") == "watch_upgrade", "watch_upgrade"), (x("risk_control_level").isNotNull(), "risk_control"), (s6, "reactivate"),
        (s1 & ((x("bonuses") >= 2) | ka), "deep_binding"), (s1, "key_upkeep"), (s3, "growth"), (s4, "category"), (x("value_tier").isin("S", "A"), "key_upkeep"), (x("value_tier") == "B", "silent_upkeep"), default="silent_watch",
    )
    level = cases(
        (x("strategy").isin("risk_control", "watch_upgrade"), x("risk_control_level")), ((x("strategy") == "reactivate") & (x("streak_down") >= 3), "weak"), (x("strategy") == "reactivate", "advised"), default=F.lit(None).cast("string")
    )
    t = t.withColumn("strategy", name).withColumn("strategy_level", level)
    return t.select("customer_id", "strategy", "strategy_level", "bonuses", "trading_months", "risk_control_level", "owner", "value_tier", "tier", "activity")


def alerts(log: DataFrame, p: DataFrame) -> DataFrame:
    """Alerts of priority 1 to 3 customers: number and joined messages (few anomaly kinds per customer)."""
    x = F.col
    pri = cases(((x("activity") == "inactive") | (x("value_tier") == "dormant"), 5), ((x("value_tier") == "S") | x("tier").isin("KA", "AA"), 1), (x("value_tier") == "A", 2), (x("value_tier") == "B", 3), default=4)
    j = log.join(p.select("customer_id", pri.alias("priority"), "owner"), "customer_id").filter(x("priority") < 4).filter((x("anomaly") != "revenue_cliff") | (x("priority") <= 2))
    msg = cases(
        ((x("level") == "high") & (x("priority") <= 2), F.concat(F.lit("[urgent] "), "anomaly", F.lit(": "), "detail")), (x("level") == "high", F.concat(F.lit("[watch] "), "anomaly")),
        ((x("level") == "medium") & (x("priority") <= 2), F.concat(F.lit("[note] "), "anomaly", F.lit(": "), "detail")), default=F.lit(None).cast("string"),
    )
    return j.withColumn("m", msg).filter(x("m").isNotNull()).groupBy("customer_id").agg(
        F.count("*").alias("alerts"), F.array_join(F.array_sort(F.collect_list("m")), "; ").alias("messages"), F.max("owner").alias("owner")
    )


def action_table(strategy: DataFrame, alert: DataFrame, glory: DataFrame, declines: DataFrame) -> DataFrame:
    """Strategy, alerts, best period and worst declining product of each customer in one row."""
    worst = declines.filter(F.col("rank") == 1).select("customer_id", F.col("product_id").alias("worst_product"), F.col("change_pct").alias("worst_change"))
    return (
        strategy.select("customer_id", "strategy", "strategy_level").join(alert.select("customer_id", "alerts", "messages"), "customer_id", "left")
        .join(glory.select("customer_id", "best_revenue", "best_product"), "customer_id", "left").join(worst, "customer_id", "left").na.fill(0, ["alerts"])
    )
