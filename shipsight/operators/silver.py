"""Monthly aggregates of the shipment fact and first-seen attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import div, first_by, top_k

MONEY = ("qty", "revenue", "cost", "profit")


def _sums():
    return [F.sum(m).alias(m) for m in MONEY]


def customer_month(fact: DataFrame) -> DataFrame:
    """Customer x month sums, distinct orders (rows when there is no order id) and margin."""
    orders = F.count_distinct("order_id") if "order_id" in fact.columns else F.count("*")
    return (
        fact.filter(F.col("month").isNotNull() & F.col("customer_id").isNotNull())
        .groupBy("customer_id", "month", "month_idx")
        .agg(*_sums(), orders.alias("orders"))
        .withColumn("margin", div("profit", "revenue"))
    )


def product_month(fact: DataFrame, extra=()) -> DataFrame:
    """Product x month sums; average price only where the net quantity is positive."""
    return (
        fact.filter(F.col("month").isNotNull() & F.col("product_id").isNotNull())
        .groupBy("product_id", *extra, "month", "month_idx")
        .agg(*_sums(), F.bool_or("is_new").alias("is_new"))
        .withColumn("avg_price", F.when(F.col("qty") > 0, div("revenue", "qty")))
        .withColumn("margin", div("profit", "revenue"))
    )


def customer_product_month(fact: DataFrame, extra=()) -> DataFrame:
    return (
        fact.filter(F.col("month").isNotNull())
        .groupBy("customer_id", "product_id", *extra, "month", "month_idx")
        .agg(*_sums())
        .withColumn("margin", div("profit", "revenue"))
        .withColumn("price", div("revenue", "qty"))
    )


def customer_attributes(fact: DataFrame, attrs) -> DataFrame:
    """First non-null value of each attribute in (ship_date, order_id, line_no) order."""
    return fact.groupBy("customer_id").agg(
        *[first_by(a, "ship_date", "order_id", "line_no").alias(a) for a in attrs]
    )


def product_line_of(fact: DataFrame) -> DataFrame:
    """One line per product (the most frequent), so a join on it never multiplies rows."""
    counted = fact.filter(F.col("product_line").isNotNull()).groupBy("product_id", "product_line").agg(
        F.count("*").alias("n")
    )
    return top_k(counted, ["product_id"], [F.desc("n"), F.asc("product_line")], 1).select("product_id", "product_line")


def with_product_line(cpm: DataFrame, fact: DataFrame) -> DataFrame:
    return cpm.join(product_line_of(fact), "product_id", "left")


def silver_layer(rows: DataFrame, fill_customer: str | None = None, trim_day: int | None = None) -> dict[str, DataFrame]:
    """Clean rows once, then the three monthly tables from the same cleaned frame.

    The caller persists `rows` when more than one table is written.
    """
    from . import cleaning

    fact = cleaning.coerce_date(rows, "ship_date")
    if fill_customer:
        fact = cleaning.fill_key(fact, "customer_id", fill_customer)
    if trim_day:
        fact = cleaning.trim_incomplete_month(fact, trim_day)
    return {
        "rows": fact,
        "customer_month": customer_month(fact),
        "product_month": product_month(fact),
        "customer_product_month": with_product_line(customer_product_month(fact), fact),
    }


def daily_kpi(fact: DataFrame, latest: int, k: int = 5) -> DataFrame:
    """Per-day sales KPIs, month-to-date running values of the latest month, top customers and products as text."""
    days = fact.groupBy("ship_date", "month_idx").agg(
        F.sum("revenue").alias("revenue"),
        F.sum("qty").alias("qty"),
        F.count_distinct("order_id").alias("orders"),
        F.count_distinct("customer_id").alias("customers"),
        F.count_distinct("product_id").alias("products"),
    )
    mtd = Window.partitionBy("month_idx").orderBy("ship_date").rowsBetween(Window.unboundedPreceding, 0)
    now = F.col("month_idx") == latest
    days = days.withColumn("mtd_revenue", F.when(now, F.sum("revenue").over(mtd))).withColumn(
        "mtd_day", F.when(now, F.row_number().over(Window.partitionBy("month_idx").orderBy("ship_date")))
    )

    def leaders(key: str, out: str) -> DataFrame:
        g = fact.groupBy("ship_date", key).agg(F.sum("revenue").alias("r"))
        best = top_k(g, ["ship_date"], [F.desc("r"), F.asc(key)], k)
        text = F.concat(F.col(key).cast("string"), F.lit(":"), F.round("r", 0).cast("bigint").cast("string"))
        return best.groupBy("ship_date").agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]), "; "
            ).alias(out)
        )

    return days.join(leaders("customer_id", "top_customers"), "ship_date", "left").join(
        leaders("product_id", "top_products"), "ship_date", "left"
    )
