"""Period comparisons: calendar-keyed change rates and volume/price effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import c, cases, dbl, div


def at_lag(value, keys, idx: str, lag: int):
    """Value of the same series `lag` calendar periods earlier (NULL when that period is absent)."""
    w = Window.partitionBy(*keys).orderBy(idx).rangeBetween(-lag, -lag)
    return F.max(c(value)).over(w)


def change_pct(value, keys, idx: str, lag: int):
    """Percent change against the calendar period `lag` steps back, relative to its absolute value."""
    prev = at_lag(value, keys, idx, lag)
    return div(c(value) - prev, F.abs(prev)) * 100


def with_changes(df: DataFrame, measures, keys, idx: str, lags: dict[str, int]) -> DataFrame:
    return df.select(
        "*",
        *[change_pct(m, keys, idx, lag).alias(f"{m}_{label}") for label, lag in lags.items() for m in measures],
    )


def _measures(customers: bool, orders: bool):
    out = [
        dbl(F.sum("revenue")).alias("revenue"),
        dbl(F.sum("profit")).alias("profit"),
        dbl(F.sum("qty")).alias("qty"),
    ]
    if customers:
        out.append(F.count_distinct("customer_id").alias("customers"))
    if orders:
        out.append(F.count_distinct("order_id").alias("orders"))
    return out


def period_overview(fact: DataFrame) -> DataFrame:
    """Month and quarter rows of the company with change against the previous period and the year before."""
    measures = ("revenue", "profit", "qty", "asp")

    def level(name: str, idx, start, back: int) -> DataFrame:
        g = (
            fact.filter(F.col("month").isNotNull())
            .groupBy(idx.alias("period_idx"), start.alias("period_start"))
            .agg(*_measures(True, True))
            .select(
                F.lit(name).alias("level"),
                "*",
                div("revenue", "qty").alias("asp"),
                (div("profit", "revenue") * 100).alias("margin"),
            )
        )
        return with_changes(g, measures, ["level"], "period_idx", {"prev_pct": 1, "yoy_pct": back})

    quarter_idx = (F.year("month") * 4 + F.quarter("month")).cast("int")
    return level("month", F.col("month_idx"), F.col("month"), 12).unionByName(
        level("quarter", quarter_idx, F.trunc("month", "quarter"), 4)
    )


def volume_price(fact: DataFrame, keys) -> DataFrame:
    """Revenue change against the previous observed month, split into volume and price effects."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("month_idx")
    g = fact.groupBy(*keys, "month_idx").agg(
        dbl(F.sum("revenue")).alias("revenue"), dbl(F.sum("qty")).alias("qty")
    ).withColumn("price", div("revenue", "qty"))
    q0, p0, r0 = (F.lag(x).over(w) for x in ("qty", "price", "revenue"))
    g = g.select(
        "*",
        ((F.col("qty") - q0) * p0).alias("volume_effect"),
        ((F.col("price") - p0) * F.col("qty")).alias("price_effect"),
        (F.col("revenue") - r0).alias("change"),
    )
    up_v, up_p = F.col("volume_effect") >= 0, F.col("price_effect") >= 0
    return g.withColumn("residual", F.col("change") - F.col("volume_effect") - F.col("price_effect")).withColumn(
        "tag",
        cases(
            (F.col("change").isNull(), F.lit(None)),
            (up_v & up_p, "both_up"),
            (up_v, "volume_led"),
            (up_p, "price_led"),
            default="both_down",
        ),
    )


def _radar(df: DataFrame, key: str, customers: bool) -> DataFrame:
    g = df.groupBy(key, "month_idx").agg(*_measures(customers, False)).withColumn("asp", div("revenue", "qty"))
    return with_changes(g, ("revenue", "profit", "qty"), [key], "month_idx", {"mom_pct": 1, "yoy_pct": 12})


def key_account_radar(fact: DataFrame, customers: DataFrame, tiers) -> DataFrame:
    """Customer x month measures with calendar MoM and YoY for the given tiers."""
    keep = customers.filter(F.col("tier").isin(*tiers)).select("customer_id")
    return _radar(fact.join(keep, "customer_id", "left_semi"), "customer_id", False)


def owner_month(fact: DataFrame, customers: DataFrame) -> DataFrame:
    """Owner x month measures; the owner is the customer's, rows of customers without one drop out."""
    monthly = fact.groupBy("customer_id", "month_idx").agg(
        *[F.sum(m).alias(m) for m in ("revenue", "profit", "qty")]
    )
    owned = customers.filter(F.col("owner").isNotNull()).select("customer_id", "owner")
    return _radar(monthly.join(owned, "customer_id"), "owner", True)
