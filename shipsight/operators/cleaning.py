"""Row cleaning: names, dates, keys, returns, incomplete months and back-filled attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import c, cases, clip, dbl, div, first_by, top_k


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_superseded(df: DataFrame, names) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def row_margin(df: DataFrame, lower: float = -0.5, upper: float = 0.75, apply_clip: bool = False) -> DataFrame:
    """Row margin and profit used for sums; clipping is off unless asked for."""
    margin = div("profit", "revenue")
    clipped = F.when(F.col("revenue") > 0, clip(margin, lower, upper) * dbl("revenue")).otherwise(dbl("profit"))
    return df.withColumn("row_margin", margin).withColumn("profit_used", clipped if apply_clip else dbl("profit"))


def handle_returns(df: DataFrame, strict: bool = False) -> DataFrame:
    """Returns stay and net out in sums; strict keeps positive quantities only."""
    return df.filter(F.col("qty") > 0) if strict else df


def coerce_date(df: DataFrame, col: str) -> DataFrame:
    """Dates that cannot be parsed become NULL and their rows drop out."""
    kind = df.schema[col].dataType.typeName()
    parsed = F.col(col) if kind in ("date", "timestamp") else F.try_to_timestamp(F.col(col)).cast("date")
    return df.withColumn(col, parsed).filter(F.col(col).isNotNull())


def date_window(df: DataFrame, col: str, start) -> DataFrame:
    return df.filter(F.col(col) >= F.lit(start))


def trim_incomplete_month(df: DataFrame, min_day: int = 25, date: str = "ship_date") -> DataFrame:
    """Drop the newest month unless its data reaches `min_day`."""
    last = df.agg(F.max(date).alias("d"))
    keep_to = last.select(
        F.when(F.dayofmonth("d") < min_day, F.date_sub(F.trunc("d", "month"), 1)).otherwise(F.col("d"))
    ).scalar()
    return df.filter(F.col(date) <= keep_to)


def fill_key(df: DataFrame, col: str, sentinel) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(sentinel)))


def drop_sentinels(df: DataFrame, col: str, sentinels) -> DataFrame:
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*sentinels))


GRADE_WORDS = (("KA", "A"), ("AA", "A"), ("KM", "B"), ("MM", "C"))


def customer_info(rows: DataFrame, order=("ship_date", "order_id", "line_no")) -> DataFrame:
    """First known tier text and owner of each customer, with the grade the tier text maps to."""
    g = rows.groupBy("customer_id").agg(
        first_by("tier", *order).alias("tier"), first_by("owner", *order).alias("owner")
    )
    grade = cases(*[(F.contains(F.col("tier"), F.lit(w)), v) for w, v in GRADE_WORDS], default="unknown")
    return g.withColumn("grade", grade)


def backfill_line(rows: DataFrame, default: str = "unclassified") -> DataFrame:
    """Missing product line := the product's most frequent line, else the default, with a source tag."""
    counted = rows.filter(F.col("product_line").isNotNull()).groupBy("product_id", "product_line").agg(
        F.count("*").alias("n")
    )
    best = top_k(counted, ["product_id"], [F.desc("n"), F.asc("product_line")], 1).select(
        "product_id", F.col("product_line").alias("_line")
    )
    return (
        rows.join(best, "product_id", "left")
        .withColumn(
            "line_source",
            cases(
                (F.col("product_line").isNotNull(), "source"),
                (F.col("_line").isNotNull(), "same_product"),
                default="default",
            ),
        )
        .withColumn("product_line", F.coalesce("product_line", "_line", F.lit(default)))
        .drop("_line")
    )


def line_conflicts(rows: DataFrame) -> DataFrame:
    """Products that carry more than one line, with the lines and their row counts (few per product)."""
    n = rows.filter(F.col("product_line").isNotNull()).groupBy("product_id", "product_line").agg(
        F.count("*").alias("n")
    )
    text = F.transform(
        F.array_sort(F.collect_list(F.struct("product_line", "n"))),
        lambda x: F.concat(x["product_line"], F.lit(":"), x["n"].cast("string")),
    )
    return (
        n.groupBy("product_id")
        .agg(F.count("*").alias("lines"), F.sum("n").alias("rows"), F.array_join(text, "; ").alias("candidates"))
        .filter(F.col("lines") > 1)
    )


def key_fallback(df: DataFrame, sources, out: str = "customer_id", default: str = "unknown") -> DataFrame:
    """First non-blank of the source columns, with the name of the column it came from."""
    def clean(s):
        return F.nullif(F.trim(F.col(s).cast("string")), F.lit(""))

    tag = cases(*[(clean(s).isNotNull(), s) for s in sources], default="default")
    return df.withColumn(f"{out}_source", tag).withColumn(out, F.coalesce(*[clean(s) for s in sources], F.lit(default)))


def map_region(df: DataFrame, mapping: dict[str, str], col: str = "dept", out: str = "region", default: str = "unknown") -> DataFrame:
    """Constant map look-up as a literal map expression."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out, F.coalesce(F.try_element_at(pairs, c(col)), F.lit(default)))
