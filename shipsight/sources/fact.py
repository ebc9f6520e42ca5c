"""The shipment fact over the star tables, joining only the dimensions the caller asks for."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import month_idx, scalar_int
from ..functions.settle import settle
from ..operators import silver

TIER_LIMITS = ((9000, "KA"), (7500, "AA"), (4500, "KM"))
DISTRIBUTOR_SEGMENTS = ("AUTOMOBILE", "BUILDING")
NEW_PART_SIZE = 46

_CUSTOMER = {"channel", "tier", "region"}
_PART = {"product_line", "category", "is_new"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _money(expr):
    return expr.cast("decimal(18,4)")


def sales_fact(spark: SparkSession, folder: str, cols, since=None) -> DataFrame:
    """Selected fact columns. `since` (a date) is compared with the scan column, so it reaches the files."""
    need = set(cols)
    f = table(spark, folder, "lineitem")
    if since is not None:
        f = f.filter(F.col("l_shipdate") >= F.lit(since).cast("timestamp"))
    if need & (_CUSTOMER | {"customer_id"}):
        f = f.join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if need & _CUSTOMER:
        cust = table(spark, folder, "customer")
        if "region" in need:
            cust = cust.join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
                table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
            )
        f = f.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    if need & _PART:
        f = f.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if "owner" in need:
        f = f.join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    returned = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)
    sgn = F.when(returned, F.lit(-1)).otherwise(F.lit(1))
    price = F.col("l_extendedprice")
    revenue = _money(sgn * price * (1 - F.col("l_discount")))
    cost = _money(sgn * price * (F.lit(0.60) + F.lit(5) * F.col("l_tax")))
    tier = F.when(F.col("c_acctbal") >= TIER_LIMITS[0][0], TIER_LIMITS[0][1])
    for limit, label in TIER_LIMITS[1:]:
        tier = tier.when(F.col("c_acctbal") >= limit, label)
    exprs = {
        "ship_date": lambda: F.col("l_shipdate").cast("date"),
        "month": lambda: F.trunc(F.col("l_shipdate").cast("date"), "month"),
        "month_idx": lambda: month_idx("l_shipdate"),
        "order_id": lambda: F.col("l_orderkey"),
        "line_no": lambda: F.col("l_linenumber"),
        "customer_id": lambda: F.col("o_custkey"),
        "product_id": lambda: F.col("l_partkey"),
        "product_line": lambda: F.col("p_brand"),
        "category": lambda: F.col("p_type"),
        "is_new": lambda: F.col("p_size") >= NEW_PART_SIZE,
        "owner": lambda: F.col("s_name"),
        "region": lambda: F.col("r_name"),
        "channel": lambda: F.when(F.col("c_mktsegment").isin(*DISTRIBUTOR_SEGMENTS), "distributor").otherwise("direct"),
        "tier": lambda: tier.otherwise("MM"),
        "qty": lambda: _money(sgn * F.col("l_quantity")),
        "revenue": lambda: revenue,
        "cost": lambda: cost,
        "profit": lambda: revenue - cost,
    }
    return f.select(*[exprs[k]().alias(k) for k in cols])


class Warehouse:
    """Lazy views over one folder of star tables: the fact, its monthly aggregates and key attributes."""

    MONEY = ["qty", "revenue", "cost", "profit"]

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def latest(self) -> int:
        """Newest month number: one row of one column, so later windows are literals that push down."""
        return scalar_int(table(self.spark, self.folder, "lineitem"), month_idx(F.max("l_shipdate")))

    def since(self, months: int):
        """First day of the `months`-month window that ends with the latest month."""
        i = self.latest - months
        from datetime import date

        return date(i // 12, i % 12 + 1, 1)

    @cached_property
    def stored(self) -> "Warehouse":
        """The same views over monthly tables written once, for operators that read them many times."""
        return StoredWarehouse(self.spark, self.folder)

    def fact(self, *cols: str, months: int | None = None) -> DataFrame:
        return sales_fact(self.spark, self.folder, cols, self.since(months) if months else None)

    def customer_month(self, months: int | None = None) -> DataFrame:
        return silver.customer_month(
            self.fact("customer_id", "month", "month_idx", "order_id", *self.MONEY, months=months)
        )

    def product_month(self, months: int | None = None, line: bool = False) -> DataFrame:
        extra = ["product_line"] if line else []
        return silver.product_month(
            self.fact("product_id", "month", "month_idx", "is_new", *extra, *self.MONEY, months=months), extra
        )

    def customer_product_month(self, months: int | None = None, extra=()) -> DataFrame:
        return silver.customer_product_month(
            self.fact("customer_id", "product_id", "month", "month_idx", *extra, *self.MONEY, months=months), extra
        )

    def customers(self, *attrs: str) -> DataFrame:
        """One row per buying customer: channel, tier, region and first owner."""
        want = attrs or ("channel", "tier", "region", "owner")
        return silver.customer_attributes(
            self.fact("customer_id", "ship_date", "order_id", "line_no", *want), want
        )

    def portrait_months(self) -> DataFrame:
        from ..operators import product

        # Nearly every row is a product's only one of its month: dealt as they are, once, for all that goes by product.
        return product.product_month(
            self.fact("product_id", "month_idx", "is_new", "category", "product_line", "qty", "revenue", "profit").repartition("product_id")
        )

    def customer_product_revenue(self, months: int | None = None) -> DataFrame:
        return (
            self.fact("product_id", "customer_id", "month_idx", "revenue", months=months)
            .repartition("product_id")
            .groupBy("product_id", "customer_id", "month_idx")
            .agg(F.sum("revenue").alias("revenue"))
        )

    def product_portrait(self, offsets=(0,)) -> DataFrame:
        """Scored product portraits at `latest - n` for each offset."""
        from ..operators import product

        return product.product_portrait(
            self.portrait_months(), self.customer_product_revenue(max(offsets) + 12), [self.latest - n for n in offsets]
        )

    def scored_portrait(self) -> DataFrame:
        from ..operators import scoring

        return scoring.scored_portrait(self.stored)


class StoredWarehouse(Warehouse):
    """Warehouse whose monthly tables and attributes are written once, on first use; the fact itself is read as it is."""

    @cached_property
    def _cm(self) -> DataFrame:
        return settle(super().customer_month())

    @cached_property
    def _pm(self) -> DataFrame:
        return settle(super().product_month(line=True))

    @cached_property
    def _cpm(self) -> DataFrame:
        return settle(super().customer_product_month(extra=("product_line", "category")))

    @cached_property
    def _cust(self) -> DataFrame:
        return settle(super().customers())

    @cached_property
    def _portrait(self) -> DataFrame:
        from ..operators import customer, pricing

        return settle(customer.portrait(self, pricing))

    @cached_property
    def _scored(self) -> DataFrame:
        return settle(super().scored_portrait())

    @cached_property
    def _products(self) -> DataFrame:
        return settle(super().product_portrait())

    def _recent(self, df: DataFrame, months: int | None) -> DataFrame:
        return df.filter(F.col("month_idx") > self.latest - months) if months else df

    def customer_month(self, months: int | None = None) -> DataFrame:
        return self._recent(self._cm, months)

    def product_month(self, months: int | None = None, line: bool = True) -> DataFrame:
        return self._recent(self._pm, months)

    def customer_product_month(self, months: int | None = None, extra=()) -> DataFrame:
        return self._recent(self._cpm, months)

    def customers(self, *attrs: str) -> DataFrame:
        return self._cust.select("customer_id", *attrs) if attrs else self._cust

    def portrait(self) -> DataFrame:
        return self._portrait

    def scored_portrait(self) -> DataFrame:
        return self._scored

    def product_portrait(self, offsets=(0,)) -> DataFrame:
        return self._products if tuple(offsets) == (0,) else super().product_portrait(offsets)
