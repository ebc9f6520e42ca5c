"""Volatility of the monthly series and journey stages. Series are monthly, so windows are calendar-bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import cases, count_if, dbl, div, total_if, within
from ..functions.distribution import quantiles
from ..functions.settle import settle


def volatility(cm: DataFrame, zero_limits=(0.75, 0.95), cv_limits=(3.0, 6.0)) -> DataFrame:
    """CV, largest one-month fall, share of months without purchase and trend R2 over all months of the data.

    Months without a purchase count as zero. Their effect on every sum is known in closed form, so the series
    is not blown up to one row per customer and month.
    """
    months = cm.select("month_idx").distinct()
    pos = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("month_idx")) - 1
    months = months.withColumn("x", dbl(pos))
    all_m = months.agg(
        F.struct(dbl(F.count("*")).alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.max("x").alias("last")).alias("s")
    ).scalar()
    w = Window.partitionBy("customer_id").orderBy("month_idx")
    rows = cm.join(months, "month_idx").withColumn("_a", all_m).withColumn("y", dbl("revenue"))
    before = F.when(F.lag("x").over(w) == F.col("x") - 1, F.lag("y").over(w)).when(F.col("x") == 0, F.lit(None)).otherwise(0.0)
    gap_after = F.coalesce(F.lead("x").over(w), F.col("_a.last") + 1) > F.col("x") + 1
    fall = F.when(F.col("y") < before, (before - F.col("y")) / F.greatest(before, F.lit(1.0)))
    to_zero = F.when(gap_after & (F.col("y") > 0), F.col("y") / F.greatest("y", F.lit(1.0)))
    g = rows.select("customer_id", "x", "y", "_a", F.greatest(fall, to_zero).alias("drop")).groupBy("customer_id").agg(
        F.first("_a").alias("a"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"),
        F.sum(F.col("x") * F.col("y")).alias("sxy"), F.coalesce(F.max("drop"), F.lit(0.0)).alias("max_drop"),
        count_if(F.col("y") != 0).alias("nz"),
    )
    n, sx, sxx = F.col("a.n"), F.col("a.sx"), F.col("a.sxx")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    cov = F.col("sxy") - sx * F.col("sy") / n
    vx = sxx - sx * sx / n
    mean = F.col("sy") / n
    cv = F.when(mean > 0, F.sqrt(F.greatest(vy, F.lit(0.0)) / F.nullif(n - 1, F.lit(0.0))) / F.nullif(mean, F.lit(0.0))).otherwise(999.0)
    r2 = F.when((n >= 3) & (vy > 0), cov * cov / F.nullif(vx * vy, F.lit(0.0))).otherwise(0.0)
    zero = (n - F.col("nz")) / n
    g = g.select("customer_id", F.coalesce(cv, F.lit(0.0)).alias("revenue_cv"), "max_drop", zero.alias("zero_share"), F.coalesce(r2, F.lit(0.0)).alias("trend_r2"))
    part = lambda v, a, b: cases((v < a, 100.0), (v < b, 60.0), default=20.0)
    pts = part(F.col("revenue_cv"), *cv_limits) * 0.4 + part(F.col("zero_share"), *zero_limits) * 0.3 + F.greatest("trend_r2", F.lit(0.0)) * 100 * 0.3
    return g.withColumn("stability_score", pts).withColumn(
        "stability", cases((F.col("stability_score") >= 70, "high"), (F.col("stability_score") >= 40, "medium"), default="volatile")
    )


def historical_stages(cm: DataFrame, last: int = 12, intro: int = 6, fall: float = 0.9, rise: float = 1.1) -> DataFrame:
    """Stage of each of a customer's newest rows, judged from the three rows that follow it."""
    w = Window.partitionBy("customer_id").orderBy("month_idx")
    idx = F.row_number().over(w) - 1
    t = cm.select("customer_id", "month_idx", dbl("revenue").alias("y"), idx.alias("i"), F.count("*").over(Window.partitionBy("customer_id")).alias("n"))
    t = t.select("*", *[F.lead("y", k).over(w).alias(f"f{k}") for k in (1, 2, 3)])
    first = F.min(F.when(F.col("y") > 0, F.col("i"))).over(Window.partitionBy("customer_id"))
    f1, f2, f3 = F.col("f1"), F.col("f2"), F.col("f3")
    one = lambda cond: F.coalesce(cond.cast("int"), F.lit(0))
    falls, rises = one(f2 < f1 * fall) + one(f3 < f2 * fall), one(f2 > f1 * rise) + one(f3 > f2 * rise)
    enough = f2.isNotNull()
    stage = cases(
        (F.col("y") == 0, "lost"), (F.col("i") - F.coalesce("_f", "i") <= intro, "onboarding"), (enough & (falls >= 2), "decline"),
        (enough & (falls >= 1), "warning"), (enough & (rises >= 2), "ramp"), default="stable",
    )
    t = t.withColumn("_f", first).withColumn("row_stage", stage)
    return t.filter((F.col("n") >= 3) & (F.col("i") >= F.col("n") - last)).select("customer_id", "month_idx", "i", "n", "row_stage")


def stage_history(cm: DataFrame, current: DataFrame, **kw) -> DataFrame:
    """Months the current stage has lasted and number of stage changes over the newest rows."""
    h = historical_stages(cm, **kw).join(current.select("customer_id", "journey"), "customer_id")
    w = Window.partitionBy("customer_id").orderBy("month_idx")
    t = h.select(
        "customer_id", (F.col("n") - 1 - F.col("i")).alias("back"), (F.col("row_stage") == F.col("journey")).alias("same"),
        (F.col("row_stage") != F.lag("row_stage").over(w)).alias("moved"), F.count("*").over(Window.partitionBy("customer_id")).alias("k"),
    )
    run = F.coalesce(F.min(F.when(~F.col("same"), F.col("back"))), F.max("k"))
    return t.groupBy("customer_id").agg(F.greatest(run, F.lit(1)).cast("int").alias("stage_months"), count_if(F.col("moved")).alias("stage_changes"))


def journey(
    cm: DataFrame, latest: int, channels: DataFrame | None = None, intro_months: int = 6, intro_orders: int = 3, growth: float = 0.3,
    surge: float = 2.0, mature_cv: float = 0.3, mature_top: float = 0.3, decline: float = 0.2, decline_run: int = 2, churn_days: int = 180,
    reactivation_days: int = 180, days_per_month: int = 30,
) -> DataFrame:
    """Journey stage by precedence: reactivated, onboarding, lost, decline, growth, mature, stable.

    Mature customers outside the top share of their channel's 6-month revenue become stable.
    """
    w = Window.partitionBy("customer_id").orderBy("month_idx")
    r6 = within(latest, 6)
    t = cm.select("*", (F.col("month_idx") - F.lag("month_idx").over(w)).alias("gap"), (r6 & (F.col("revenue") < F.lag("revenue").over(w)) & (F.lag("month_idx").over(w) > latest - 6)).alias("fell"),
                  F.row_number().over(Window.partitionBy("customer_id").orderBy(F.desc("month_idx"))).alias("back"))
    r12 = F.when(within(latest, 12), dbl("revenue"))
    g = t.groupBy("customer_id").agg(
        (F.lit(latest) - F.max("month_idx")).alias("since"), (F.lit(latest) - F.min("month_idx")).alias("age"), F.min("month").alias("first_month"),
        F.sum("orders").alias("orders"), F.max("gap").alias("max_gap"),
        *[total_if(within(latest, n, s), "revenue").alias(a) for a, n, s in (("r6", 6, 0), ("p6", 6, 6), ("r3", 3, 0), ("p3", 3, 3))],
        F.avg(r12).alias("m12"), F.stddev_samp(r12).alias("s12"), F.count(r12).alias("n12"), count_if(r6).alias("n6"),
        F.min(F.when(~F.coalesce("fell", F.lit(False)), F.col("back") - 1)).alias("run"),
    )
    ratio = lambda a, b, cond: F.when(cond, a / F.greatest(b, F.lit(1.0))).otherwise(0.0)
    g = g.withColumns({
        "growth_6m": ratio(F.col("r6") - F.col("p6"), F.col("p6"), F.col("p6") > 0),
        "revenue_surge": ratio(F.col("r3"), F.col("p3"), F.col("p3") > 0),
        "cv_12m": F.when((F.col("n12") > 1) & F.col("m12").isNotNull(), F.col("s12") / F.greatest("m12", F.lit(1.0))).otherwise(999.0),
        "falls": F.when(F.col("n6") > 0, F.coalesce("run", F.lit(0))).otherwise(0),
    })
    stage = cases(
        ((F.col("max_gap") > reactivation_days / days_per_month) & (F.col("since") <= 1), "reactivated"),
        ((F.col("age") <= intro_months) & (F.col("orders") <= intro_orders), "onboarding"),
        ((F.col("since") > churn_days / days_per_month) & (F.col("r6") == 0), "lost"),
        ((F.col("growth_6m") <= -decline) & (F.col("falls") >= decline_run), "decline"),
        ((F.col("growth_6m") >= growth) | (F.col("revenue_surge") >= surge), "growth"),
        (F.col("cv_12m") < mature_cv, "mature"), default="stable",
    )
    g = settle(g.withColumn("journey", stage))
    if channels is not None:
        g = g.join(channels.select("customer_id", "channel"), "customer_id", "left")
    else:
        g = g.withColumn("channel", F.lit("all"))
    g = g.withColumn("channel", F.coalesce("channel", F.lit("unknown")))
    bar = quantiles(g.filter(F.col("r6") > 0), ["channel"], "r6", {"bar": 1 - mature_top})
    g = g.join(bar, "channel", "left").withColumn("journey", F.when((F.col("journey") == "mature") & (F.col("r6") < F.col("bar")), "stable").otherwise(F.col("journey")))
    return g.select("customer_id", "journey", "first_month", (F.col("since") * days_per_month).cast("bigint").alias("days_since"), "growth_6m", "cv_12m", "falls", dbl("r6").alias("revenue_6m"))


def journey_full(cm: DataFrame, latest: int, channels: DataFrame | None = None, **kw) -> DataFrame:
    j = settle(journey(cm, latest, channels, **kw))
    return j.join(stage_history(cm, j), "customer_id", "left").na.fill(1, ["stage_months"]).na.fill(0, ["stage_changes"])
