"""Evaluation of risk scores: ranking metrics, grid and threshold search, folds, coverage, Pareto frontier."""

from __future__ import annotations

from itertools import product as grid_product

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import c, cases, count_if, dbl, distinct_if, div, top_k, total_if
from ..functions.distribution import equal_depth, pct_rank, running
from ..functions.settle import settle


def auc(df: DataFrame, keys, score: str, label: str = "label", weight=None) -> DataFrame:
    """Area under the ROC curve per key from rank sums over distinct scores (ties share their mean rank)."""
    w = c(weight) if weight is not None else F.lit(1)
    h = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(w).alias("n"), F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("p"))
    r = running(h, keys, ["_s"], {"n": "n"})
    g = r.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("n_before") + (F.col("n") + 1) / 2.0)).alias("rs"), dbl(F.sum("p")).alias("P"), dbl(F.sum("n")).alias("N"))
    return g.select(*keys, div(F.col("rs") - F.col("P") * (F.col("P") + 1) / 2, F.col("P") * (F.col("N") - F.col("P"))).alias("auc"), F.col("N").cast("bigint").alias("samples"), F.col("P").cast("bigint").alias("positives"))


def confusion(df: DataFrame, keys, flagged, label: str = "label") -> DataFrame:
    y = F.col(label) == 1
    g = df.groupBy(*keys).agg(count_if(flagged & y).alias("tp"), count_if(flagged & ~y).alias("fp"), count_if(~flagged & y).alias("fn"), count_if(~flagged & ~y).alias("tn"))
    p, r = div("tp", F.col("tp") + F.col("fp")), div("tp", F.col("tp") + F.col("fn"))
    return g.select("*", p.alias("precision"), r.alias("recall"), div(2 * p * r, p + r).alias("f1"), div(5 * p * r, 4 * p + r).alias("f2"), div("tn", F.col("tn") + F.col("fp")).alias("specificity"), (div("fp", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")) * 1000).alias("false_per_1000"))


def classification_metrics(df: DataFrame, score: str, threshold: float, keys=()) -> DataFrame:
    keys = list(keys)
    if not keys:
        return classification_metrics(df.withColumn("_all", F.lit(1)), score, threshold, ["_all"]).drop("_all")
    return auc(df, keys, score).join(confusion(df, keys, F.col(score) > threshold), keys)


def level_rates(df: DataFrame, level: str, order: dict) -> DataFrame:
    """Rate of positives per level and whether it rises from level to level."""
    g = df.groupBy(level).agg(F.count("*").alias("n"), F.avg(dbl("label")).alias("rate")).withColumn("o", cases(*[(F.col(level) == k, v) for k, v in order.items()], default=99))
    w = Window.partitionBy(F.lit(0)).orderBy("o")
    return g.select(level, "n", "rate", F.coalesce(F.col("rate") >= F.lag("rate").over(w), F.lit(True)).alias("monotone"))


def score_buckets(df: DataFrame, value: str, n: int = 5) -> DataFrame:
    """Equal-depth buckets of a value: rows, positive rate, mean value."""
    b = equal_depth(df.filter(F.col(value).isNotNull()), [], value, "bucket", n=n, dense=False)
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(dbl("label")).alias("rate"), F.avg(dbl(value)).alias("mean_value"))


def weight_grid(factors: int, step: int = 10) -> list[tuple[float, ...]]:
    """All weight vectors in steps of 1/step that add up to 1."""
    return [tuple(x / step for x in w) for w in grid_product(range(step + 1), repeat=factors) if sum(w) == step]


def grid_search(df: DataFrame, factors, step: int = 10, threshold: float = 55.0) -> DataFrame:
    """AUC, precision and recall of every weight combination.

    Rows collapse to distinct factor scores before they meet the grid, so the fan-out applies to the few distinct
    score combinations, not to the samples.
    """
    base = df.filter(F.col("label").isNotNull()).groupBy(*factors, "label").agg(F.count("*").alias("k"))
    grid = weight_grid(len(factors), step)
    arr = F.array(*[F.struct(F.lit(i).alias("combo"), *[F.lit(x).alias(f"w{j}") for j, x in enumerate(w)]) for i, w in enumerate(grid)])
    x = base.withColumn("g", F.explode(arr)).select("label", "k", "g.*", *factors)
    x = x.withColumn("score", F.round(sum(dbl(f) * F.col(f"w{j}") for j, f in enumerate(factors)), 8))
    ws = [f"w{j}" for j in range(len(factors))]
    x = settle(x.groupBy("combo", *ws, "score", "label").agg(F.sum("k").alias("k")))
    a = auc(x, ["combo"], "score", weight="k").select("combo", "auc")
    hit, y = F.col("score") > threshold, F.col("label") == 1
    m = x.groupBy("combo", *ws).agg(*[F.coalesce(F.sum(F.when(cd, F.col("k"))), F.lit(0)).alias(n) for n, cd in (("tp", hit & y), ("fp", hit & ~y), ("fn", ~hit & y))])
    return m.join(a, "combo").select("combo", *ws, "auc", div("tp", F.col("tp") + F.col("fp")).alias("precision"), div("tp", F.col("tp") + F.col("fn")).alias("recall"))


def threshold_search(df: DataFrame, score: str = "risk_score", cuts=range(30, 80, 10)) -> DataFrame:
    """Three cut points by a composite of the spread of level rates and their order, over the score histogram."""
    h = df.filter(F.col("label").isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    grid = [(a, b, d) for a in cuts for b in cuts for d in cuts if a < b < d]
    arr = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("mid"), F.lit(d).alias("high")) for a, b, d in grid])
    x = h.withColumn("g", F.explode(arr)).select("s", "n", "p", "g.*")
    lv = cases((F.col("s") <= F.col("low"), 0), (F.col("s") <= F.col("mid"), 1), (F.col("s") <= F.col("high"), 2), default=3)
    rate = lambda k: F.coalesce(div(F.sum(F.when(lv == k, F.col("p"))), F.sum(F.when(lv == k, F.col("n")))), F.lit(0.0))
    g = x.groupBy("low", "mid", "high").agg(*[rate(k).alias(f"r{k}") for k in range(4)])
    order = sum(F.when(F.col(f"r{k}") >= F.col(f"r{k - 1}"), 1).otherwise(0) for k in (1, 2, 3)) / 3.0
    return g.withColumn("objective", (F.col("r3") - F.col("r0")) * 0.6 + order * 0.4)


def time_folds(df: DataFrame, folds: int = 3, key: str = "as_of") -> DataFrame:
    """Rows tagged with each expanding fold they are tested in: fold k tests the k-th newest slice of months."""
    months = df.select(key).distinct()
    pos = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(key))) - 1
    m = months.select(key, pos.alias("b"))
    size = m.agg(F.count("*").alias("n")).scalar()
    return df.join(m, key).withColumn("fold", F.floor(F.col("b") * (folds + 1) / size).cast("int")).filter(F.col("fold") < folds).drop("b")


def time_series_cv(df: DataFrame, score: str = "risk_score", folds: int = 3) -> DataFrame:
    return auc(time_folds(df, folds), ["fold"], score)


def coverage(df: DataFrame, flagged) -> DataFrame:
    """Declined products, those ever flagged before, and the share."""
    g = df.groupBy("product_id").agg(F.bool_or(F.col("label") == 1).alias("d"), F.bool_or(flagged).alias("f"))
    return g.agg(count_if(F.col("d")).alias("declined"), count_if(F.col("d") & F.col("f")).alias("caught")).withColumn("coverage", div("caught", "declined"))


def fold_ranking(df: DataFrame, score: str = "risk_score", top: float = 0.2, target: str | None = None, factors=(), alarm: float = 65.0, highest: float = 68.0, flag: float = 55.0) -> DataFrame:
    """Per fold: AUC, average precision, hit rate and lift of the top share of scores, and figures at the alert levels.

    `f2` takes scores above `flag` as positive, `precision_highest` those above `highest`, `recall_alarm` those above `alarm`.
    With a `target`, `spearman` is its rank correlation with the score (five rows at least). Each factor adds its own AUC (ten
    rows at least) and the share of rows without it.
    """
    d = settle(time_folds(df.filter(F.col(score).isNotNull() & F.col("label").isNotNull())))
    h = d.groupBy("fold", F.col(score).alias("_s")).agg(F.count("*").alias("n"), F.sum("label").alias("p")).withColumn("_o", -F.col("_s"))
    r = running(h, ["fold"], ["_o"], {"n": "n", "p": "p"})
    tp, seen = F.col("p_before") + F.col("p"), F.col("n_before") + F.col("n")
    g = r.groupBy("fold").agg(
        div(F.sum(F.col("p") * tp / seen), F.max("p_total")).alias("average_precision"), F.sum(F.when(F.col("n_before") < F.col("n_total") * top, F.col("p"))).alias("tp"), F.sum(F.when(F.col("n_before") < F.col("n_total") * top, F.col("n"))).alias("tn"),
        F.max(div("p_total", "n_total")).alias("base"),
    )
    y, x = F.col("label") == 1, F.col(score)
    hit, wrong, lost = (count_if(c_) for c_ in ((x > flag) & y, (x > flag) & ~y, (x <= flag) & y))
    both = (F.min((x > flag).cast("int")) < F.max((x > flag).cast("int"))) & (F.min("label") < F.max("label"))
    levels = d.groupBy("fold").agg(
        F.when(both, div(5 * hit, 5 * hit + 4 * lost + wrong)).alias("f2"), F.avg(F.when(x > highest, dbl("label"))).alias("precision_highest"), div(count_if((x > alarm) & y), count_if(y)).alias("recall_alarm"),
        *[F.avg(F.col(f).isNull().cast("double")).alias(f"missing_{f}") for f in factors],
    )
    out = auc(d, ["fold"], score).join(g, "fold").select("fold", "samples", "positives", "auc", "average_precision", div("tp", "tn").alias("top_hit_rate"), div(div("tp", "tn"), "base").alias("top_lift")).join(levels, "fold")
    if target:
        out = out.join(rank_correlation(d, ["fold"], score, target).withColumnRenamed("rho", "spearman"), "fold", "left")
    for f in factors:
        out = out.join(auc(d, ["fold"], f).select("fold", F.when(F.col("samples") >= 10, F.col("auc")).alias(f"auc_{f}")), "fold", "left")
    return out


def rank_correlation(df: DataFrame, keys, a: str, b: str, least: int = 5) -> DataFrame:
    """Spearman's rank correlation of two columns per key, `rho`: the correlation of average ranks, over rows that have both.

    Null with fewer than `least` rows or where a column has one value only.
    """
    keys = list(keys)
    d = settle(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")))
    ranked = pct_rank(d, keys, "_a", "_ra").join(pct_rank(d, keys, "_b", "_rb").select(*keys, "_b", "_rb").distinct(), [*keys, "_b"])
    g = ranked.groupBy(*keys).agg(F.count("*").alias("_n"), F.covar_pop("_ra", "_rb").alias("_c"), F.stddev_pop("_ra").alias("_a"), F.stddev_pop("_rb").alias("_b"))
    return g.select(*keys, F.when(F.col("_n") >= least, div("_c", F.col("_a") * F.col("_b"))).alias("rho"))


def fold_stability(weights: DataFrame, factors) -> DataFrame:
    """CV of each factor's value over folds and mean pairwise Kendall tau of the folds (folds x factors is tiny)."""
    l = weights.unpivot(["fold"], list(factors), "factor", "w")
    cv = l.groupBy("factor").agg(div(F.stddev_samp("w"), F.avg("w")).alias("cv"))
    a, b = l.alias("a"), l.alias("b")
    pairs = a.join(b, (F.col("a.fold") == F.col("b.fold")) & (F.col("a.factor") < F.col("b.factor"))).select(F.col("a.fold").alias("fold"), F.col("a.factor").alias("x"), F.col("b.factor").alias("y"), F.signum(F.col("a.w") - F.col("b.w")).alias("s"))
    p, q = pairs.alias("p"), pairs.alias("q")
    tau = p.join(q, (F.col("p.x") == F.col("q.x")) & (F.col("p.y") == F.col("q.y")) & (F.col("p.fold") < F.col("q.fold"))).agg(F.avg(F.col("p.s") * F.col("q.s")).alias("t")).scalar()
    return cv.withColumn("mean_tau", tau)


def factor_hypothesis(df: DataFrame, factor: str, cut: float) -> DataFrame:
    """Positive rate of rows above and below a factor cut."""
    return df.filter(F.col(factor).isNotNull() & F.col("label").isNotNull()).groupBy(F.when(F.col(factor) >= cut, "high").otherwise("low").alias("side")).agg(F.count("*").alias("n"), F.avg(dbl("label")).alias("rate"))


def pareto_frontier(results: DataFrame, objectives, keys, ranges: int = 8) -> DataFrame:
    """Rows that no other row beats on all objectives (as good on each, better on one); equal rows stay together.

    Distinct objective values are cut into ranges of the first objective, highest first, so that a point can only be beaten in
    its own range or an earlier one. Each range keeps its local frontier; then the frontier of each range meets that of every
    earlier one, each pair of ranges in a group of its own, and what is beaten there goes. Rows with a null objective take no
    part.
    """
    names = list(objectives)
    points = results.select(*[dbl(o).alias(o) for o in names]).na.drop().distinct()

    def local(frames):
        part = TaskContext.get().partitionId()
        kept = np.empty((0, len(names)))
        for frame in frames:
            kept = unbeaten(np.concatenate([kept, frame[names].to_numpy(float)]))
        yield pd.DataFrame(kept, columns=names).assign(_part=part)

    kinds = ", ".join(f"`{o}` double" for o in names)
    front = settle(points.repartitionByRange(ranges, F.desc(names[0]), *[F.desc(o) for o in names[1:]]).mapInPandas(local, f"{kinds}, _part int"))
    judged = front.filter("_part > 0").withColumn("_judge", F.explode(F.sequence(F.lit(0), F.col("_part") - 1)))
    judges = front.filter(F.col("_part") < ranges - 1).withColumn("_judged", F.explode(F.sequence(F.col("_part") + 1, F.lit(ranges - 1))))
    judges = judges.select(*names, F.col("_judged").alias("_part"), F.col("_part").alias("_judge"))

    def beaten(of: pd.DataFrame, by: pd.DataFrame) -> pd.DataFrame:
        a, b = of[names].to_numpy(float), by[names].to_numpy(float)
        lost = [bool(((b >= x).all(1) & (b > x).any(1)).any()) for x in a]
        return of.loc[lost, names]

    lost = judged.groupBy("_part", "_judge").cogroup(judges.groupBy("_part", "_judge")).applyInPandas(beaten, kinds).distinct()
    best = front.join(lost, names, "left_anti").select(*[F.col(o).alias(f"_{o}") for o in names])
    same = F.lit(True)
    for o in names:
        same = same & (dbl(o) == F.col(f"_{o}"))
    return results.join(best, same, "left_semi").select(*keys, *names)


def unbeaten(points: np.ndarray) -> np.ndarray:
    """Rows that no other row beats on all columns."""
    points = points[np.lexsort(-points.T[::-1])]  # a row is only beaten by one before it
    kept, n = np.empty_like(points), 0
    for x in points:
        if not ((kept[:n] >= x).all(1) & (kept[:n] > x).any(1)).any():
            kept[n], n = x, n + 1
    return kept[:n]


def customer_factors(cpm: DataFrame, cutoffs, months: int = 6) -> DataFrame:
    """Six customer-level factors of a product at each cut-off: 6 months against the 6 before."""
    keys = ["product_id", "as_of"]
    seen = F.filter(F.array(*[F.lit(int(t)) for t in cutoffs]), lambda t: (t >= F.col("month_idx")) & (t < F.col("month_idx") + 2 * months))
    r = cpm.withColumn("as_of", F.explode(seen)).withColumn("now", F.col("as_of") - F.col("month_idx") < months)
    pc = r.groupBy(*keys, "customer_id").agg(
        total_if(F.col("now"), "revenue").alias("r1"), total_if(~F.col("now"), "revenue").alias("r0"), total_if(F.col("now"), "qty").alias("q1"), total_if(~F.col("now"), "qty").alias("q0"), count_if(F.col("now")).alias("m1"), count_if(~F.col("now")).alias("m0"),
    )
    pc = settle(pc)
    g = pc.groupBy(*keys).agg(
        F.max("r1").alias("x1"), F.sum("r1").alias("t1"), F.max("r0").alias("x0"), F.sum("r0").alias("t0"), count_if((F.col("m1") > 0) & (F.col("m0") == 0)).alias("gained"), count_if((F.col("m1") == 0) & (F.col("m0") > 0)).alias("lost"),
        div(F.stddev_samp(F.when(F.col("q1") > 0, F.col("r1") / F.nullif(F.col("q1"), F.lit(0.0)))), F.avg(F.when(F.col("q1") > 0, F.col("r1") / F.nullif(F.col("q1"), F.lit(0.0))))).alias("price_cv"),
        F.sum("q1").alias("q1"), F.sum("q0").alias("q0"), F.sum("m1").alias("m1"), F.sum("m0").alias("m0"),
    )
    top = top_k(pc.filter(F.col("r0") > 0), keys, [F.desc("r0"), F.asc("customer_id")], 5).groupBy(*keys).agg(div(count_if(F.col("m1") == 0), F.count("*")).alias("top5_churn"))
    return g.join(top, keys, "left").select(
        *keys, (div("x1", "t1") - div("x0", "t0")).alias("concentration_change"), "top5_churn", (F.col("gained") - F.col("lost")).alias("net_customers"), "price_cv", (div("m1", "m0") - 1).alias("frequency_change"), (div(div("q1", "m1"), div("q0", "m0")) - 1).alias("order_qty_change"),
    )
