"""Bridges between customers and product portraits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import dbl, distinct_if, div, total_if

PORTRAITS = ("growth", "cash_cow", "warning_growth", "hidden_decline", "sunset", "decline")
DECLINING = ("warning_growth", "hidden_decline", "decline")


def customer_product_bridge(cpm: DataFrame, portraits: DataFrame) -> DataFrame:
    """Customer x product x month rows with six columns of the product portrait."""
    p = portraits.select("product_id", "portrait", "risk_level", "pareto", "zone", "growth", F.col("margin").alias("product_margin"))
    return cpm.join(p, "product_id", "left")


def portfolio_health(bridge: DataFrame) -> DataFrame:
    """Products, revenue, revenue by portrait and declining share of each customer."""
    g = bridge.groupBy("customer_id").agg(
        F.count_distinct("product_id").alias("products"), dbl(F.sum("revenue")).alias("revenue"), *[total_if(F.col("portrait") == p, "revenue").alias(p) for p in PORTRAITS]
    )
    bad = sum(F.col(p) for p in DECLINING)
    return g.withColumn("declining_share", F.when(F.col("revenue") > 0, bad / F.nullif(F.col("revenue"), F.lit(0.0))).otherwise(0.0))


def portfolio_pivot(bridge: DataFrame) -> DataFrame:
    """Revenue pivoted by portrait as shares of the customer's total, with the risk share."""
    piv = bridge.groupBy("customer_id").pivot("portrait", list(PORTRAITS)).agg(dbl(F.sum("revenue")))
    tot = bridge.groupBy("customer_id").agg(dbl(F.sum("revenue")).alias("revenue"))
    j = piv.na.fill(0.0).join(tot, "customer_id")
    return j.select("customer_id", "revenue", *[div(p, "revenue").alias(f"{p}_share") for p in PORTRAITS], div(sum(F.col(p) for p in DECLINING), "revenue").alias("risk_share"))


def product_customers(cpm: DataFrame, customers: DataFrame, risky=("decline", "sleep", "lost")) -> DataFrame:
    """Customers, revenue and high-risk customers of each product."""
    j = cpm.join(customers.select("customer_id", "lifecycle"), "customer_id", "left")
    return j.groupBy("product_id").agg(F.count_distinct("customer_id").alias("customers"), dbl(F.sum("revenue")).alias("revenue"), distinct_if(F.col("lifecycle").isin(*risky), "customer_id").alias("risky_customers"))
