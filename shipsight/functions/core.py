"""Column and DataFrame helpers shared by every operator family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dbl(x) -> Column:
    return c(x).cast("double")


def div(num, den) -> Column:
    """num / den as DOUBLE, NULL when the denominator is zero or NULL."""
    return dbl(num) / F.nullif(dbl(den), F.lit(0.0))


def sum_if(cond: Column, value) -> Column:
    """Sum of value over rows meeting cond, 0 when none does."""
    return F.coalesce(F.sum(F.when(cond, c(value))), F.lit(0))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def distinct_if(cond: Column, value) -> Column:
    return F.count_distinct(F.when(cond, c(value)))


def clip(x, lo: float, hi: float) -> Column:
    """Clip keeping NULL (greatest/least alone would skip it)."""
    return F.when(c(x).isNotNull(), F.least(F.greatest(dbl(x), F.lit(float(lo))), F.lit(float(hi))))


def buckets(x, steps, default) -> Column:
    """Value of the first (limit, value) step with x >= limit; steps run downwards."""
    expr = None
    for limit, value in steps:
        cond = c(x) >= F.lit(limit)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(F.lit(default))


def cases(*pairs, default=None) -> Column:
    """Ordered rule chain: first true condition wins."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    chain = F.when(pairs[0][0], lit(pairs[0][1]))
    for cond, value in pairs[1:]:
        chain = chain.when(cond, lit(value))
    return chain.otherwise(lit(default))


def within(latest: int, months: int, skip: int = 0, idx="month_idx") -> Column:
    """True for the `months` months that end `skip` months before the latest one."""
    return (c(idx) > latest - skip - months) & (c(idx) <= latest - skip)


def month_idx(day) -> Column:
    return (F.year(c(day)) * 12 + F.month(c(day))).cast("int")


def idx_to_month(idx) -> Column:
    """First day of the month numbered year*12+month."""
    i = c(idx) - 1
    return F.make_date(F.floor(i / 12).cast("int"), (F.pmod(i, F.lit(12)) + 1).cast("int"), F.lit(1))


def top_k(df: DataFrame, keys, order, k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. `row_number() <= k` lets Spark prune map-side before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def mode_by(df: DataFrame, keys, value: str, out: str | None = None) -> DataFrame:
    """Most frequent non-null value per key, ties to the smallest value."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return top_k(counted, keys, [F.desc("_n"), F.asc(value)], 1, "_r").select(
        *keys, F.col(value).alias(out or value)
    )


def first_by(value: str, *order: str, cond: Column | None = None) -> Column:
    """Aggregate: value of the earliest row that has one (order columns break ties)."""
    ok = F.col(value).isNotNull() if cond is None else cond & F.col(value).isNotNull()
    return F.min_by(value, F.when(ok, F.struct(*[F.col(o) for o in order], F.col(value))))


def unpivot_measures(df: DataFrame, keys, measures, name="measure", value="value") -> DataFrame:
    return df.unpivot(list(keys), list(measures), name, value)


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def newest_first(keys, idx="month_idx", name="_r"):
    """(column name, row number) with the newest row = 1. Groups are monthly series, so calendar-bounded."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(idx)))


def scalar_int(df: DataFrame, expr: Column) -> int:
    """One aggregate value brought to the driver (a single row, whatever the input size)."""
    return df.agg(expr.alias("v")).first()["v"]


def mean_if(cond: Column, value) -> Column:
    """Mean of an exact (decimal) column over rows meeting cond; sums first, so row order cannot matter."""
    v = F.when(cond, c(value))
    return div(F.sum(v), F.count(v))


def mean(value) -> Column:
    return div(F.sum(c(value)), F.count(c(value)))


def total_if(cond: Column, value) -> Column:
    """Conditional sum as DOUBLE, 0 when no row qualifies."""
    return F.coalesce(dbl(F.sum(F.when(cond, c(value)))), F.lit(0.0))


def left_join_all(base: DataFrame, frames, on) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "left"), frames, base)
