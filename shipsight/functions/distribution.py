"""Exact order statistics that never put one key's rows into one task.

Running sums, ranks and quantiles need an order inside each key. A plain window would sort a whole key in one
task, and `percentile` would hold it in one buffer. Here the input is collapsed to distinct (key, value) rows, cut along the
(key, value) order into ranges at splitters taken from a hash-chosen sample; each range is sorted on its own and the totals of
the ranges before it are added. Every size takes this one path: the size of the input and the splitters are scalar subqueries
over the collapsed rows, which are written once, so that plans do not nest. The sample depends only on the data, so a
recomputed task finds the same splitters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import c, cases, dbl
from .settle import settle

RANGES = 64
#: Sampled positions per range.
SAMPLED = 32


def _splitters(df: DataFrame, pos: Column, ranges: int) -> Column:
    """At most `ranges` - 1 ascending positions that cut the rows into about equal ranges, as a scalar subquery."""
    step = F.greatest(F.floor(df.agg(F.count("*")).scalar() / (ranges * SAMPLED)), F.lit(1))
    sample = df.select(pos.alias("p")).filter(F.pmod(F.xxhash64("p"), step) == 0).agg(F.sort_array(F.collect_list("p")).alias("s"))
    nth = lambda i: F.element_at("s", F.floor(i * F.size("s") / ranges).cast("int") + 1)
    cuts = F.when(F.size("s") >= ranges, F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), nth)).otherwise(F.slice("s", 1, 0))
    # One row with the sorted sample; `inline` keeps the optimizer from sorting it anew for each cut.
    return sample.select(F.inline(F.array(F.struct("s")))).select(cuts).scalar()


def _below(cuts: Column, pos: Column, ranges: int) -> Column:
    """How many of the ascending cuts lie under a position, by halving."""
    steps = [1 << i for i in reversed(range(max(ranges - 1, 1).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda i, step: F.when(F.try_element_at(cuts, i + step) < pos, i + step).otherwise(i))


def _borders(placed: DataFrame, keys: list[str], names: list[str]) -> Column:
    """For keys that a cut runs through, what their earlier ranges and all their ranges hold: range -> entries, at most two.

    Ranges follow the (key, value) order, so only the keys of cuts lie in several ranges: a bounded table, a scalar subquery.
    """
    key = F.struct(F.lit(0).alias("_"), *keys)
    cut = F.exists("_cuts", lambda x: F.struct(F.lit(0).alias("_"), *[x[k].alias(k) for k in keys]) == key) if keys else F.lit(True)
    totals = placed.filter(cut).groupBy(key.alias("key"), "_rng").agg(*[F.sum(f"{n}_w").alias(n) for n in names])
    per_key = Window.partitionBy("key")
    earlier = per_key.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    entry = F.struct("key", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_off") for n in names], *[F.sum(n).over(per_key).alias(f"{n}_all") for n in names])
    by_range = totals.select("_rng", entry.alias("e")).groupBy("_rng").agg(F.collect_list("e").alias("entries"))
    return by_range.agg(F.map_from_entries(F.collect_list(F.struct("_rng", "entries")))).scalar()


def running(df: DataFrame, keys, order, weights: dict[str, Column | str], ranges: int = RANGES) -> DataFrame:
    """Add `<name>_before` (sum over earlier rows of the key) and `<name>_total` for each weight.

    `order` lists ascending columns; (keys, order) must be unique. The input is written once (see `settle`).
    """
    keys, order, names = list(keys), list(order), list(weights)
    df = settle(df)
    pos = F.struct(*[F.col(k) for k in keys + order])
    weighed = df.select("*", *[c(w).alias(f"{n}_w") for n, w in weights.items()])
    placed = weighed.withColumn("_cuts", _splitters(df, pos, ranges)).withColumn("_rng", _below(F.col("_cuts"), pos, ranges))
    part = Window.partitionBy("_rng", *keys)
    inside = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.drop("_cuts").select(
        "*", *[F.coalesce(F.sum(f"{n}_w").over(inside), F.lit(0)).alias(f"{n}_in") for n in names], *[F.sum(f"{n}_w").over(part).alias(f"{n}_rw") for n in names]
    )
    key = F.struct(F.lit(0).alias("_"), *keys)
    entry = F.try_element_at(F.filter(F.try_element_at(F.col("_map"), F.col("_rng")), lambda e: e["key"] == key), F.lit(1))
    found = ordered.withColumn("_map", _borders(placed, keys, names)).withColumn("_e", entry)
    return found.select(
        *df.columns,
        *[(F.col(f"{n}_in") + F.coalesce(F.col(f"_e.{n}_off"), F.lit(0))).alias(f"{n}_before") for n in names],
        *[F.coalesce(F.col(f"_e.{n}_all"), F.col(f"{n}_rw")).alias(f"{n}_total") for n in names],
    )


def _edge(name: str, p: float, before: str, count: str, total: str, value: str):
    """Aggregates for one linear-interpolated quantile over (value, count) rows."""
    at = F.lit(float(p)) * (F.col(total) - 1)
    lo, hi = F.floor(at), F.ceil(at)
    end = F.col(before) + F.col(count)
    return [
        F.max(F.when((F.col(before) <= lo) & (lo < end), dbl(value))).alias(f"{name}_lo"),
        F.max(F.when((F.col(before) <= hi) & (hi < end), dbl(value))).alias(f"{name}_hi"),
        F.max(at - lo).alias(f"{name}_f"),
    ]


def _point(name: str):
    return (F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * F.col(f"{name}_f")).alias(name)


def histogram(df: DataFrame, keys, value) -> DataFrame:
    return (
        df.select(*keys, c(value).alias("_v")).filter(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    )


def quantiles(df: DataFrame, keys, value, probs: dict[str, float], count_as: str | None = None, **kw) -> DataFrame:
    """Linear-interpolated quantiles per key, one row per key with a column per entry of `probs`."""
    keys = list(keys)
    r = running(histogram(df, keys, value), keys, ["_v"], {"w": "_n"}, **kw)
    aggs = [a for name, p in probs.items() for a in _edge(name, p, "w_before", "_n", "w_total", "_v")]
    out = r.groupBy(*keys).agg(*aggs, F.max("w_total").alias("_cnt"))
    return out.select(*keys, *[_point(n) for n in probs], *([F.col("_cnt").alias(count_as)] if count_as else []))


def pct_rank(df: DataFrame, keys, value: str, out: str, **kw) -> DataFrame:
    """Average rank / count per key (ties share the mean rank); NULL values get NULL."""
    keys = list(keys)
    r = running(histogram(df, keys, value), keys, ["_v"], {"w": "_n"}, **kw).select(
        *keys,
        F.col("_v").alias(value),
        ((F.col("w_before") + (F.col("_n") + 1) / F.lit(2.0)) / F.col("w_total")).alias(out),
    )
    return df.join(r, [*keys, value], "left")


def equal_depth(
    df: DataFrame, keys, value: str, out: str, n: int = 5, ascending: bool = True, dense: bool = True, of: DataFrame | None = None, **kw
) -> DataFrame:
    """Score 1..n by equal-depth bins of the value's dense rank (or the value itself).

    `of` is the frame whose values make the bins, `df` unless given: where several scores are added to one frame, each
    takes its bins from the frame as it was, so that plans don't nest.

    Bin edges are linear-interpolated quantiles, closed on the right. The middle score is given when edges
    coincide and to missing values. `ascending` means larger values score higher.
    """
    keys = list(keys)
    r = running(histogram(df if of is None else of, keys, value), keys, ["_v"], {"d": F.lit(1), "w": "_n"}, **kw)
    r = r.withColumn("_x", dbl(F.col("d_before") + 1) if dense else dbl("_v"))
    names = {f"_e{i}": i / n for i in range(n + 1)}
    aggs = [a for name, p in names.items() for a in _edge(name, p, "w_before", "_n", "w_total", "_x")]
    edges = r.groupBy(*keys).agg(*aggs).select(*keys, *[_point(e) for e in names])
    if keys:
        joined = r.join(edges, keys)
    else:
        joined = r.withColumn("_e", one_row(edges)).select("*", *[F.col(f"_e.{e}").alias(e) for e in names])
    distinct = F.lit(True)
    for i in range(n):
        distinct = distinct & (F.col(f"_e{i}") < F.col(f"_e{i + 1}"))
    middle = (n + 1) // 2
    label = [(F.col("_x") <= F.col(f"_e{i}"), i if ascending else n + 1 - i) for i in range(1, n)]
    score = cases((~F.coalesce(distinct, F.lit(False)), middle), *label, default=n if ascending else 1)
    scored = joined.select(*keys, F.col("_v").alias(value), score.cast("int").alias(out))
    return df.join(scored, [*keys, value], "left").na.fill(middle, [out])


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery."""
    return df.select(F.struct(*df.columns).alias("s")).scalar()


def minmax_score(value, lo: Column, hi: Column, reverse: bool = False) -> Column:
    """Scale to 0..100 between lo and hi; 50 when the span is empty or the value is missing."""
    v, span = dbl(value), dbl(hi) - dbl(lo)
    part = (dbl(hi) - v) if reverse else (v - dbl(lo))
    return F.when(v.isNull() | span.isNull() | (span == 0), F.lit(50.0)).otherwise(part / F.nullif(span, F.lit(0.0)) * 100)
