"""Risk signals from eight channels, their merge, month-over-month state and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import cases, dbl, total_if, union_all
from ..functions.distribution import running
from .anomaly import level_rank


def signal(df: DataFrame, entity: str, kind, level, loss, channel: str) -> DataFrame:
    return df.select(
        F.col(entity).cast("string").alias("entity"), (kind if not isinstance(kind, str) else F.lit(kind)).alias("kind"), (level if not isinstance(level, str) else F.lit(level)).alias("level"),
        dbl(F.coalesce(loss, F.lit(0.0)) if loss is not None else F.lit(0.0)).alias("loss"), F.lit(channel).alias("channel"),
    )


def parse_detail(log: DataFrame, col: str = "detail") -> DataFrame:
    """Numbers read from the free text of an anomaly: revenue, growth percent, months."""
    num = lambda pat: F.regexp_extract(F.col(col), pat, 1).try_cast("double")
    return log.withColumns({"d_revenue": num(r"revenue=(-?[\d.,]+)"), "d_growth": num(r"growth=(-?[\d.]+)%"), "d_months": num(r"months=(\d+)").cast("int")})


def channel_anomaly(log: DataFrame, levels=("high", "medium")) -> DataFrame:
    return signal(log.filter(F.col("level").isin(*levels)), "customer_id", F.col("anomaly"), F.col("level"), None, "anomaly_log")


def channel_negative_margin(neg: DataFrame, min_loss: float = 10_000.0) -> DataFrame:
    d = neg.filter((F.col("loss_products") > 0) & (F.col("loss") <= -min_loss))
    lv = cases((F.col("severity") == "severe", "high"), (F.col("severity") == "watch", "medium"), (F.col("severity") == "slight", "low"), default="medium")
    return signal(d, "customer_id", "negative_margin", lv, F.abs("loss"), "negative_margin")


def channel_revenue_shock(trend: DataFrame, month_idx: int, min_revenue: float = 100_000.0, drop: float = -50.0, surge: float = 50.0) -> DataFrame:
    """The month's rows with a fall (high, loss = previous - current) or a surge (medium) against the previous observed month."""
    d = trend.filter((F.col("month_idx") == month_idx) & F.col("mom").isNotNull() & (F.col("revenue") >= min_revenue) & ((F.col("mom") <= drop) | (F.col("mom") >= surge)))
    down = F.col("mom") <= drop
    prev = F.when(F.col("mom") > -100, F.col("revenue") / F.nullif(1 + F.col("mom") / 100, F.lit(0.0))).otherwise(0.0)
    return signal(d, "customer_id", F.when(down, "revenue_cliff").otherwise("new_import"), F.when(down, "high").otherwise("medium"), F.when(down, F.greatest(prev - F.col("revenue"), F.lit(0.0))), "revenue_shock")


def channel_interruption(p: DataFrame, min_revenue: float = 0.0, high_days: float = 120.0) -> DataFrame:
    d = p.filter(F.col("interrupted") & (F.col("revenue_12m") >= min_revenue))
    return signal(d, "customer_id", "purchase_interruption", F.when(F.col("days_since") >= high_days, "high").otherwise("medium"), None, "purchase_interruption")


def channel_margin_drop(p: DataFrame, min_drop: float = 5.0, high_drop: float = 15.0, min_revenue: float = 500_000.0, sign: int = -1) -> DataFrame:
    """Margin change of the portrait is negative when margin falls; `sign` 1 takes the column as a drop."""
    drop = F.col("margin_change_pct") * sign
    return signal(p.filter((drop >= min_drop) & (F.col("revenue_12m") >= min_revenue)), "customer_id", "margin_drop", F.when(drop >= high_drop, "high").otherwise("medium"), None, "margin_deterioration")


def channel_decline_risk(health: DataFrame, min_share: float = 0.30, high_share: float = 0.50) -> DataFrame:
    return signal(health.filter(F.col("declining_share") >= min_share), "customer_id", "decline_risk", F.when(F.col("declining_share") >= high_share, "high").otherwise("medium"), None, "decline_risk")


def channel_risky_product(portraits: DataFrame, levels=("high", "very_high"), min_revenue: float = 200_000.0) -> DataFrame:
    d = portraits.filter(F.col("risk_level").isin(*levels) & (F.col("r12_r") >= min_revenue))
    return signal(d, "product_id", "high_risk_product", F.when(F.col("risk_level") == "very_high", "high").otherwise("medium"), None, "high_risk_product")


def channel_pricing(fairness: DataFrame, min_gap: float = 10.0, high_gap: float = 20.0) -> DataFrame:
    d = fairness.filter(F.col("low_price_anomaly") & (F.abs("gap_pct") >= min_gap))
    return signal(d, "customer_id", "pricing_anomaly", F.when(F.col("gap_pct") <= -high_gap, "high").otherwise("medium"), None, "pricing_anomaly")


def merge_signals(signals: DataFrame) -> DataFrame:
    """One row per entity: worst level, largest loss, kinds in order of severity. Pre-aggregated per (entity, kind)."""
    k = signals.groupBy("entity", "kind").agg(F.min(level_rank(F.col("level"))).alias("r"), F.max("loss").alias("loss"), F.count("*").alias("n"))
    item = F.struct(F.col("r"), (-F.col("loss")).alias("l"), F.col("kind"))
    g = k.groupBy("entity").agg(F.min("r").alias("r"), F.max("loss").alias("loss"), F.sum("n").alias("signals"), F.transform(F.array_sort(F.collect_list(item)), lambda z: z["kind"]).alias("kinds"))
    return g.select("entity", cases((F.col("r") == 0, "high"), (F.col("r") == 1, "medium"), (F.col("r") == 2, "low"), default="other").alias("level"), "loss", "signals", "kinds")


def change_class(loss, prev_loss, level, prev_level, band: float = 0.1, least: float = 10_000.0):
    """Worse or better by loss (beyond 10 % and 10,000), else by level, else equal."""
    both = (prev_loss > 0) & (loss > 0)
    a, b = level_rank(level), level_rank(prev_level)
    return cases(
        (both & (loss > prev_loss * (1 + band)) & (loss - prev_loss >= least), "worse"), (both & (loss < prev_loss * (1 - band)) & (prev_loss - loss >= least), "better"), (a < b, "worse"), (a > b, "better"), default="equal",
    )


def month_over_month(current: DataFrame, previous: DataFrame) -> DataFrame:
    """New, continuing (n-th month) or released entities; a match needs a shared kind. `previous` carries `months`."""
    p = previous.select("entity", F.col("level").alias("p_level"), F.col("loss").alias("p_loss"), F.col("kinds").alias("p_kinds"), F.col("months").alias("p_months"))
    j = current.join(p, "entity", "full_outer")
    hit = F.coalesce(F.arrays_overlap("kinds", "p_kinds"), F.lit(False))
    now = F.col("level").isNotNull()
    state = cases((now & hit, "continuing"), (now, "new"), default="released")
    rows = j.select(
        "entity", state.alias("state"), F.when(now & hit, F.col("p_months") + 1).when(now, 0).otherwise(F.col("p_months")).cast("int").alias("months"), F.coalesce("level", "p_level").alias("level"), F.coalesce("loss", "p_loss").alias("loss"),
        F.when(now & hit, change_class(F.col("loss"), F.col("p_loss"), F.col("level"), F.col("p_level"))).alias("change"), F.coalesce("kinds", "p_kinds").alias("kinds"), (now & F.col("p_level").isNotNull() & ~hit).alias("_both"), "p_level", "p_loss", "p_months", "p_kinds",
    )
    # An entity whose kinds changed completely is new and, for its old kinds, released.
    gone = rows.filter("_both").select("entity", F.lit("released").alias("state"), F.col("p_months").cast("int").alias("months"), F.col("p_level").alias("level"), F.col("p_loss").alias("loss"), F.lit(None).cast("string").alias("change"), F.col("p_kinds").alias("kinds"))
    return rows.drop("_both", "p_level", "p_loss", "p_months", "p_kinds").unionByName(gone)


def backfill_signals(cm: DataFrame, month_idx: int, min_revenue: float = 100_000.0, drop: float = -50.0, surge: float = 50.0, min_loss: float = 10_000.0) -> DataFrame:
    """Two channels recomputed from monthly rows for any month: revenue shock and a loss-making month."""
    g = cm.filter(F.col("month_idx").between(month_idx - 1, month_idx)).groupBy("customer_id").agg(
        total_if(F.col("month_idx") == month_idx, "revenue").alias("r"), total_if(F.col("month_idx") == month_idx - 1, "revenue").alias("p"), total_if(F.col("month_idx") == month_idx, "profit").alias("m")
    )
    mom = F.when(F.col("p") > 0, (F.col("r") - F.col("p")) / F.nullif(F.col("p"), F.lit(0.0)) * 100)
    g = g.withColumn("mom", mom)
    cliff = g.filter((F.col("p") >= min_revenue) & (F.col("mom") <= drop))
    rise = g.filter((F.col("r") >= min_revenue) & (F.col("mom") >= surge))
    loss = g.filter(F.col("m") <= -min_loss)
    return union_all([
        signal(cliff, "customer_id", "revenue_cliff", "high", F.col("p") - F.col("r"), "revenue_shock"), signal(rise, "customer_id", "new_import", "medium", None, "revenue_shock"),
        signal(loss, "customer_id", "negative_margin", "medium", -F.col("m"), "negative_margin"),
    ])


def ranked_list(merged: DataFrame, n: int = 10) -> DataFrame:
    """Merged signals ordered by level, then loss; the first n are listed, the rest overflow."""
    t = merged.withColumns({"_r": level_rank(F.col("level")), "_l": -F.col("loss")})
    r = running(t, [], ["_r", "_l", "entity"], {"n": F.lit(1)})
    pos = F.col("n_before") + 1
    return r.select("entity", "level", "loss", "signals", F.array_join("kinds", ", ").alias("kinds"), pos.alias("rank"), F.when(pos <= n, "listed").otherwise("overflow").alias("part"))
