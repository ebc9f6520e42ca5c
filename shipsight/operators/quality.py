"""Data quality: rule checks in one pass, table profiles and their comparison, rule-impact scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import c, cases, clip, count_if, dbl, div, total_if, union_all, within
from ..functions.distribution import one_row, quantiles


def missing_columns(df: DataFrame, required) -> list[str]:
    return [x for x in required if x not in df.columns]


def null_rates(df: DataFrame, cols, max_pct: float = 0.0) -> DataFrame:
    """Null share of each column against a limit: one aggregate for all columns, then one row per column."""
    g = df.agg(*[F.avg(F.col(x).isNull().cast("double")).alias(x) for x in cols])
    return g.unpivot([], list(cols), "column", "null_rate").withColumn("passed", F.coalesce(F.col("null_rate") <= max_pct, F.lit(True)))


def value_ranges(df: DataFrame, limits: dict) -> DataFrame:
    """Rows below and above limits per column, with minimum and maximum."""
    g = df.agg(*[
        F.struct(
            count_if(dbl(x) < lo).alias("below") if lo is not None else F.lit(0).cast("bigint").alias("below"), count_if(dbl(x) > hi).alias("above") if hi is not None else F.lit(0).cast("bigint").alias("above"),
            dbl(F.min(x)).alias("minimum"), dbl(F.max(x)).alias("maximum"),
        ).alias(x) for x, (lo, hi) in limits.items()
    ])
    return g.unpivot([], list(limits), "column", "v").select("column", "v.*").withColumn("passed", (F.col("below") + F.col("above")) == 0)


def category_values(df: DataFrame, col: str, allowed) -> DataFrame:
    """Values outside the allowed set with their rows."""
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*allowed)).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("rows"))


def staged_validation(df: DataFrame, stage: str, required, nulls: dict | None = None, ranges: dict | None = None, categories: dict | None = None) -> DataFrame:
    """All checks of one layer as (stage, check, column, bad rows, passed): one aggregate over the table."""
    spark = df.sparkSession
    gone = set(missing_columns(df, required))
    checks = []
    for x, pct in (nulls or {}).items():
        if x not in gone:
            checks.append(("null", x, count_if(F.col(x).isNull()), pct))
    for x, (lo, hi) in (ranges or {}).items():
        if x not in gone:
            bad = (dbl(x) < lo if lo is not None else F.lit(False)) | (dbl(x) > hi if hi is not None else F.lit(False))
            checks.append(("range", x, count_if(bad), 0.0))
    for x, allowed in (categories or {}).items():
        if x not in gone:
            checks.append(("category", x, count_if(F.col(x).isNotNull() & ~F.col(x).isin(*allowed)), 0.0))
    checks.append(("not_empty", "*", F.when(F.count("*") == 0, 1).otherwise(0), 0.0))
    items = F.array(*[
        F.struct(F.lit(k).alias("check"), F.lit(x).alias("column"), n.cast("bigint").alias("bad"), F.lit(float(p)).alias("limit")) for k, x, n, p in checks
    ])
    g = df.agg(F.count("*").alias("n"), items.alias("i")).select("n", F.explode("i").alias("x")).select(
        F.lit(stage).alias("stage"), "x.check", "x.column", "x.bad", (F.col("x.bad") <= F.col("x.limit") * F.col("n")).alias("passed")
    )
    if not gone:
        return g
    absent = spark.createDataFrame([(stage, "required", x, 1, False) for x in sorted(gone)], g.schema)
    return g.unionByName(absent)


def cleaning_summary(df: DataFrame, checks: dict) -> DataFrame:
    """Row counts by reason and after cleaning, as (check, n)."""
    g = df.agg(*[F.expr(e).alias(k) if isinstance(e, str) else e.alias(k) for k, e in checks.items()])
    return g.unpivot([], list(checks), "check", "n")


def channel_report(fact: DataFrame, allowed=("direct", "distributor"), limit: float = 0.05) -> DataFrame:
    """Channel problems: non-standard values, missing channel or agent, customers in both channels, months with a high other share."""
    other = ~F.col("channel").isin(*allowed) | F.col("channel").isNull()
    counts = fact.agg(
        count_if(F.col("channel").isNotNull() & ~F.col("channel").isin(*allowed)).alias("non_standard"), count_if(F.col("channel").isNull()).alias("missing"),
        count_if((F.col("channel") == "distributor") & F.col("agent").isNull()).alias("distributor_without_agent"),
    ).unpivot([], ["non_standard", "missing", "distributor_without_agent"], "issue", "n")
    both = fact.filter(F.col("channel").isin(*allowed)).groupBy("customer_id").agg(F.count_distinct("channel").alias("k")).filter(F.col("k") > 1).agg(F.lit("both_channels").alias("issue"), F.count("*").alias("n"))
    months = fact.groupBy("month_idx").agg(div(F.sum(F.when(other, F.col("revenue"))), F.sum("revenue")).alias("s")).filter(F.col("s") > limit).agg(F.lit("months_over_limit").alias("issue"), F.count("*").alias("n"))
    return union_all([counts, both, months])


def tier_anomalies(fact: DataFrame, allowed=("KA", "AA", "KM", "MM"), k: int = 30) -> tuple[DataFrame, DataFrame]:
    """Rows with a tier outside the allowed set: totals per value, and the k customers with most revenue."""
    bad = fact.filter(F.col("tier").isNull() | ~F.col("tier").isin(*allowed))
    values = bad.groupBy("tier").agg(F.count("*").alias("rows"), dbl(F.sum("revenue")).alias("revenue"), F.count_distinct("customer_id").alias("customers"))
    top = bad.groupBy("customer_id").agg(dbl(F.sum("revenue")).alias("revenue")).orderBy(F.desc("revenue"), F.asc("customer_id")).limit(k)
    return values, top


def table_profile(df: DataFrame, name: str) -> DataFrame:
    """Rows, columns, schema hash and per numeric column sum and nulls, as (table, measure, column, value)."""
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "decimal", "integer", "long", "short", "byte")]
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    items = [("rows", "*", F.count("*").cast("double")), ("columns", "*", F.lit(float(len(df.columns)))), ("schema", "*", F.max(F.crc32(F.lit(schema))).cast("double"))]
    items += [("sum", x, dbl(F.sum(F.col(x).cast("decimal(38,4)")))) for x in numeric] + [("nulls", x, count_if(F.col(x).isNull()).cast("double")) for x in df.columns]
    arr = F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(x).alias("column"), F.coalesce(v, F.lit(0.0)).alias("value")) for m, x, v in items])
    return df.agg(arr.alias("a")).select(F.lit(name).alias("table"), F.explode("a").alias("x")).select("table", "x.*")


def profile_drift(base: DataFrame, current: DataFrame, rel: float = 1e-6, near_zero: float = 1e-6) -> DataFrame:
    """Entries of two profiles that differ beyond the tolerance or exist on one side only."""
    keys = ["table", "measure", "column"]
    j = base.withColumnRenamed("value", "base_value").join(current.withColumnRenamed("value", "current_value"), keys, "full_outer")
    a, b = F.col("base_value"), F.col("current_value")
    close = F.abs(a - b) <= F.greatest(F.lit(near_zero), F.abs(a) * rel)
    return j.withColumn("drift", cases((a.isNull(), "added"), (b.isNull(), "removed"), (~close, "changed"))).filter(F.col("drift").isNotNull())


SCENARIOS = ("keep_raw", "keep_clip", "drop_raw", "drop_clip")


def clean_rule_impact(fact: DataFrame, year_start: int, latest: int, lower: float = -0.5, upper: float = 0.75) -> DataFrame:
    """YTD totals with returns kept or dropped and margins raw or clipped, and the difference to keep + raw."""
    m = div("profit", "revenue")
    clipped = F.when(F.col("revenue") > 0, clip(m, lower, upper) * dbl("revenue")).otherwise(dbl("profit"))
    f = fact.filter((F.col("month_idx") >= year_start) & (F.col("month_idx") <= latest)).withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in SCENARIOS])))
    f = f.filter(~F.col("scenario").startswith("drop") | (F.col("qty") > 0))
    p = F.when(F.col("scenario").endswith("clip"), clipped).otherwise(dbl("profit"))
    g = f.groupBy("scenario").agg(F.count("*").alias("rows"), dbl(F.sum("revenue")).alias("revenue"), F.sum(F.round(p, 4).cast("decimal(28,4)")).cast("double").alias("profit"))
    base = one_row(g.filter(F.col("scenario") == SCENARIOS[0]).agg(F.max("revenue").alias("r"), F.max("profit").alias("p")))
    return g.withColumn("_b", base).select("*", (F.col("revenue") - F.col("_b.r")).alias("revenue_diff"), (F.col("profit") - F.col("_b.p")).alias("profit_diff"), (div("profit", "revenue") * 100).alias("margin")).drop("_b")


def scenario_stages(fact: DataFrame, latest: int) -> DataFrame:
    """Approximate product stage (3 months against 3 before, recent against overall margin) counted per scenario."""
    f = fact.withColumn("scenario", F.explode(F.array(F.lit("keep"), F.lit("drop")))).filter((F.col("scenario") == "keep") | (F.col("qty") > 0))
    g = f.groupBy("scenario", "product_id").agg(
        total_if(within(latest, 3), "qty").alias("l3"), total_if(within(latest, 3, 3), "qty").alias("p3"), div(F.sum(F.when(within(latest, 3), F.col("profit"))), F.sum(F.when(within(latest, 3), F.col("revenue")))).alias("mr"), div(F.sum("profit"), F.sum("revenue")).alias("ma"),
    )
    gr = F.when(F.col("p3") > 0, (F.col("l3") - F.col("p3")) / F.nullif(F.col("p3"), F.lit(0.0))).otherwise(0.0)
    mom = cases((gr > 0.15, "up"), (gr > -0.10, "flat"), default="down")
    health = cases((F.col("mr").isNull(), "unknown"), (F.col("mr") >= F.col("ma"), "good"), (F.col("mr") >= F.col("ma") * 0.5, "fair"), default="bad")
    return g.groupBy("scenario", F.concat(mom, F.lit("_"), health).alias("stage")).agg(F.count("*").alias("products"))


def axis_bounds(df: DataFrame, col, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    v = F.when(~F.isnan(dbl(col)), dbl(col))
    return quantiles(df.select(v.alias("v")), [], "v", {"low": lo, "high": hi})


def compression(df: DataFrame, col) -> DataFrame:
    """Share of values outside the percentile axis bounds."""
    b = one_row(axis_bounds(df, col))
    v = dbl(col)
    return df.select(v.alias("v")).filter(F.col("v").isNotNull()).withColumn("b", b).agg(
        F.count("*").alias("values"), count_if((F.col("v") < F.col("b.low")) | (F.col("v") > F.col("b.high"))).alias("outside"), F.max("b.low").alias("low"), F.max("b.high").alias("high")
    ).withColumn("outside_share", F.col("outside") / F.nullif(F.col("values"), F.lit(0)))


def compare_forecasts(new: DataFrame, old: DataFrame, cols, key: str = "month_idx", tolerance: float = 1e-6) -> DataFrame:
    """Months on one side only and the largest relative difference per column."""
    j = new.select(key, *[F.col(x).alias(f"n_{x}") for x in cols], F.lit(1).alias("_n")).join(old.select(key, *[F.col(x).alias(f"o_{x}") for x in cols], F.lit(1).alias("_o")), key, "full_outer")
    rel = lambda x: F.abs(dbl(f"n_{x}") - dbl(f"o_{x}")) / F.greatest(F.abs(dbl(f"o_{x}")), F.lit(1.0))
    g = j.agg(count_if(F.col("_n").isNull() | F.col("_o").isNull()).alias("unmatched"), *[F.coalesce(F.max(rel(x)), F.lit(0.0)).alias(x) for x in cols])
    return g.unpivot(["unmatched"], list(cols), "column", "max_diff").withColumn("passed", (F.col("unmatched") == 0) & (F.col("max_diff") <= tolerance))
