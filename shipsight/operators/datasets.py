"""Presentation datasets: aggregation queries over the shipment fact by year-to-date, half-year and 12-month windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import c, cases, count_if, dbl, distinct_if, div, sum_if, top_k, total_if, union_all, within
from .period import at_lag

M3 = ("revenue", "profit", "qty")


@dataclass(frozen=True)
class Periods:
    """All reporting windows follow from the latest month number (year*12 + month)."""

    latest: int

    @property
    def year(self) -> int:
        return (self.latest - 1) // 12

    @property
    def month(self) -> int:
        return (self.latest - 1) % 12 + 1

    @property
    def half_start(self) -> int:
        # July still reports the finished first half.
        return self.year * 12 + (1 if self.month <= 7 else 7)

    def ytd(self, years_back: int = 0, idx="month_idx"):
        shift = 12 * years_back
        return (c(idx) > self.year * 12 - shift) & (c(idx) <= self.latest - shift)

    def half(self, back: int = 0, idx="month_idx"):
        start = self.half_start - 6 * back
        return (c(idx) >= start) & (c(idx) <= start + 5)

    def last12(self, idx="month_idx"):
        return within(self.latest, 12, idx=idx)

    def month_at(self, back: int, idx="month_idx"):
        return c(idx) == self.latest - back


def _margin(p, r):
    return F.when(F.col(r) > 0, div(p, r) * 100).otherwise(0.0)


def _growth(a, b):
    return F.when(c(b) > 0, (c(a) - c(b)) / F.nullif(c(b), F.lit(0.0)) * 100)


def _measures(cond, suffix: str, measures=M3):
    return [total_if(cond, m).alias(f"{m}_{suffix}") for m in measures]


def periods_table(spark, p: Periods) -> DataFrame:
    """The derived windows as one row."""
    names = {
        "latest": p.latest, "year": p.year, "month": p.month, "previous": p.latest - 1, "ytd_from": p.year * 12 + 1, "prior_ytd_from": p.year * 12 - 11, "prior_ytd_to": p.latest - 12,
        "last12_from": p.latest - 11, "near6_from": p.latest - 5, "prev6_from": p.latest - 11, "prev6_to": p.latest - 6, "half_from": p.half_start, "half_to": p.half_start + 5,
        "prev_half_from": p.half_start - 6, "half_last_year_from": p.half_start - 12,
    }
    return spark.range(1).select(*[F.lit(v).cast("int").alias(k) for k, v in names.items()])


def half_tags(fact: DataFrame, p: Periods) -> DataFrame:
    """Rows of the three half-year windows with their tag."""
    tag = cases((p.half(0), "current"), (p.half(1), "previous_half"), (p.half(2), "same_half_last_year"))
    return fact.withColumn("window_tag", tag).filter(F.col("window_tag").isNotNull())


def ytd_kpi(fact: DataFrame, p: Periods) -> DataFrame:
    y, py, m0, m1 = p.ytd(), p.ytd(1), p.month_at(0), p.month_at(1)
    key = F.col("tier").isin("KA", "AA")
    g = fact.filter((F.col("month_idx") > p.year * 12 - 12)).agg(
        *_measures(y, "ytd", (*M3, "cost")), *_measures(py, "py"), total_if(y & key, "revenue").alias("key_revenue"), distinct_if(y & key, "customer_id").alias("key_customers"),
        *_measures(m0, "m0", ("revenue", "qty")), *_measures(m1, "m1", ("revenue", "qty")),
    )
    asp = lambda s: div(f"revenue_{s}", f"qty_{s}")
    return g.select(
        "revenue_ytd", "profit_ytd", "cost_ytd", _margin("profit_ytd", "revenue_ytd").alias("margin"), _growth("revenue_ytd", "revenue_py").alias("revenue_yoy"), _growth("profit_ytd", "profit_py").alias("profit_yoy"),
        (div("key_revenue", "revenue_ytd") * 100).alias("key_share"), "key_customers", asp("ytd").alias("asp"), ((asp("ytd") - asp("py")) / asp("py") * 100).alias("asp_yoy"), ((asp("m0") - asp("m1")) / asp("m1") * 100).alias("asp_mom"),
    )


def monthly_slots(fact: DataFrame, p: Periods, keys=()) -> DataFrame:
    """Three years x 12 month slots per key; months without data stay NULL."""
    g = fact.filter(F.col("month_idx") > (p.year - 2) * 12).withColumn("year", F.floor((F.col("month_idx") - 1) / 12).cast("int")).withColumn("slot", (F.pmod(F.col("month_idx") - 1, F.lit(12)) + 1).cast("int"))
    piv = g.groupBy(*keys, "year").pivot("slot", list(range(1, 13))).agg(dbl(F.sum("revenue")).alias("revenue"), dbl(F.sum("profit")).alias("profit"))
    return piv.select(*keys, "year", *[F.col(f"`{i}_{m}`").alias(f"{m}_{i:02d}") for m in ("revenue", "profit") for i in range(1, 13)])


def tier_customers(fact: DataFrame, p: Periods) -> DataFrame:
    return fact.filter(p.ytd()).groupBy("tier").agg(F.count_distinct("customer_id").alias("customers"))


def key_account_scatter(fact: DataFrame, p: Periods, limit: float = 500.0) -> DataFrame:
    g = fact.filter(F.col("tier").isin("KA", "AA")).groupBy("customer_id", "tier").agg(*_measures(p.ytd(), "ytd", ("revenue", "profit")), *_measures(p.ytd(1), "py", ("revenue",)))
    gr = _growth("revenue_ytd", "revenue_py")
    return g.select("customer_id", "tier", "revenue_ytd", _margin("profit_ytd", "revenue_ytd").alias("margin"), gr.alias("growth")).filter((F.col("revenue_ytd") > 0) & (F.abs("growth") < limit))


def key_account_list(fact: DataFrame, customers: DataFrame, p: Periods) -> DataFrame:
    g = fact.groupBy("customer_id").agg(*_measures(p.ytd(), "ytd"), *_measures(p.ytd(1), "py", ("revenue",)), *_measures(p.month_at(0), "m0", ("revenue",)), *_measures(p.month_at(1), "m1", ("revenue",)))
    k = customers.filter(F.col("tier").isin("KA", "AA"))
    return k.join(g, "customer_id").select(
        "customer_id", "tier", "owner", "revenue_ytd", "profit_ytd", _margin("profit_ytd", "revenue_ytd").alias("margin"), _growth("revenue_ytd", "revenue_py").alias("yoy"), _growth("revenue_m0", "revenue_m1").alias("mom"), div("revenue_ytd", "qty_ytd").alias("asp")
    )


def newest_months(cm: DataFrame, k: int = 12) -> DataFrame:
    """The k newest observed months of each customer as one array, oldest first."""
    t = top_k(cm, ["customer_id"], [F.desc("month_idx")], k)
    return t.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("month_idx", dbl("revenue").alias("revenue"), dbl("profit").alias("profit")))).alias("series"))


def financial_blocks(cm: DataFrame, p: Periods) -> DataFrame:
    out = []
    for n, cond in (("ytd", p.ytd()), ("prior_ytd", p.ytd(1)), ("latest", p.month_at(0)), ("prev", p.month_at(1)), ("l12", p.last12())):
        out += _measures(cond, n, ("revenue", "profit"))
    g = cm.groupBy("customer_id").agg(*out)
    return g.select("*", *[_margin(f"profit_{n}", f"revenue_{n}").alias(f"margin_{n}") for n in ("ytd", "prior_ytd", "latest", "prev", "l12")])


def channel_view(fact: DataFrame, p: Periods) -> DataFrame:
    """Channel, channel x agent, channel x agent x customer and channel x month rows in one pass of grouping sets."""
    f = fact.filter(p.last12())
    sets = [["channel"], ["channel", "agent"], ["channel", "agent", "customer_id"], ["channel", "month_idx"]]
    cols = ["channel", "agent", "customer_id", "month_idx"]
    g = f.groupingSets([[F.col(x) for x in s] for s in sets], *[F.col(x) for x in cols]).agg(
        F.grouping_id(*[F.col(x) for x in cols]).alias("gid"), dbl(F.sum("revenue")).alias("revenue"), dbl(F.sum("profit")).alias("profit"), dbl(F.sum("qty")).alias("qty"), F.count("*").alias("rows"),
    )
    level = cases((F.col("gid") == 7, "channel"), (F.col("gid") == 3, "agent"), (F.col("gid") == 1, "agent_customer"), default="month")
    return g.select(level.alias("level"), *cols, "revenue", "profit", "qty", "rows", _margin("profit", "revenue").alias("margin"))


def pair_cells(cpm: DataFrame, p: Periods) -> DataFrame:
    """Customer x product x month cells of 12 months, with change rates at the pair's own last non-zero month."""
    keys = ["customer_id", "product_id"]
    t = cpm.select(*keys, "month_idx", *M3, at_lag("revenue", keys, "month_idx", 1).alias("r1"), at_lag("revenue", keys, "month_idx", 12).alias("r12"))
    ref = t.filter(F.col("revenue") != 0).groupBy(*keys).agg(F.max(F.struct("month_idx", "revenue", "r1", "r12")).alias("x"))
    rate = lambda b: (dbl("x.revenue") - dbl(b)) / F.nullif(dbl(b), F.lit(0.0)) * 100
    ref = ref.select(*keys, F.col("x.month_idx").alias("ref_idx"), rate("x.r1").alias("mom"), rate("x.r12").alias("yoy"))
    return t.filter(p.last12()).select(*keys, "month_idx", *[dbl(m).alias(m) for m in M3]).join(ref, keys, "left")


def product_switch(cpm: DataFrame, customers: DataFrame, p: Periods, bulk: float = 6000.0) -> DataFrame:
    """Per key account: bulk products bought before but not in 12 months (lost) and the other way round (gained)."""
    k = customers.filter(F.col("tier").isin("KA", "AA")).select("customer_id")
    rows = cpm.join(k, "customer_id", "left_semi")
    keys = ["customer_id", "product_id"]
    before = rows.filter(~p.last12() & (F.col("qty") >= bulk)).groupBy(*keys).agg(F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"))
    now = rows.filter(p.last12()).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in M3]).filter(F.col("qty") >= bulk)
    lost = before.join(now, keys, "left_anti").select("customer_id", F.lit("lost").alias("change"), "product_id", dbl("revenue").alias("revenue"), dbl("profit").alias("profit"))
    gained = now.join(before, keys, "left_anti").select("customer_id", F.lit("gained").alias("change"), "product_id", dbl("revenue").alias("revenue"), dbl("profit").alias("profit"))
    return lost.unionByName(gained)


def true_new_products(fact: DataFrame, p: Periods, bulk: float = 6000.0, months: int = 12) -> DataFrame:
    """Flagged new products first sold within the window, with bulk quantity this year, per customer."""
    first = fact.groupBy("product_id").agg(F.min("month_idx").alias("f")).filter(F.col("f") >= p.latest - months).select("product_id")
    g = fact.filter(F.col("is_new") & (F.col("month_idx") > p.year * 12)).join(first, "product_id", "left_semi").groupBy("customer_id", "product_id").agg(
        F.min("ship_date").alias("first_date"), dbl(F.sum("revenue")).alias("revenue"), dbl(F.sum("qty")).alias("qty")
    )
    return g.filter(F.col("qty") >= bulk)


def new_revenue_share(fact: DataFrame, p: Periods) -> DataFrame:
    return fact.filter(p.ytd()).agg(dbl(F.sum("revenue")).alias("revenue"), total_if(F.col("is_new"), "revenue").alias("new_revenue")).withColumn("new_share", div("new_revenue", "revenue") * 100)


def owner_ytd(fact: DataFrame, p: Periods) -> DataFrame:
    y = p.ytd()
    g = fact.groupBy("owner").agg(
        *_measures(y, "ytd"), distinct_if(y, "order_id").alias("orders"), distinct_if(y, "customer_id").alias("customers"), distinct_if(y, "product_line").alias("lines"),
        *_measures(p.ytd(1), "py", ("revenue",)), *_measures(p.month_at(0), "m0", ("revenue",)), *_measures(p.month_at(1), "m1", ("revenue",)),
    )
    return g.select("owner", "revenue_ytd", "profit_ytd", "qty_ytd", "orders", "customers", "lines", _growth("revenue_ytd", "revenue_py").alias("yoy"), _growth("revenue_m0", "revenue_m1").alias("mom"))


def owner_top_groups(fact: DataFrame, p: Periods, group: str, k: int) -> DataFrame:
    y = fact.filter(p.ytd())
    g = y.groupBy("owner", group).agg(F.sum("revenue").alias("v"))
    t = y.groupBy("owner").agg(F.sum("revenue").alias("t"))
    return top_k(g, ["owner"], [F.desc("v"), F.asc(group)], k).join(t, "owner").select("owner", group, "rank", dbl("v").alias("revenue"), (div("v", "t") * 100).alias("share"))


def customer_owners(fact: DataFrame) -> DataFrame:
    """Distinct (customer, owner) pairs; facts of a customer count for each of its owners."""
    return fact.select("customer_id", "owner").filter(F.col("owner").isNotNull()).distinct()


def owner_forecast_rollup(forecasts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Next-month forecasts counted up, down or flat and summed for each owner of the customer."""
    j = forecasts.join(pairs, "customer_id")
    return j.groupBy("owner").agg(*[count_if(F.col("direction") == x).alias(x) for x in ("up", "down", "flat")], F.sum("forecast").alias("forecast"), F.count("*").alias("customers"))


def six_month_change(fact: DataFrame, p: Periods, keys) -> DataFrame:
    """Revenue of the last 6 months against the 6 before, absent side 0 (a full outer join as one aggregate)."""
    g = fact.filter(within(p.latest, 12)).groupBy(*keys).agg(total_if(within(p.latest, 6), "revenue").alias("revenue_now"), total_if(within(p.latest, 6, 6), "revenue").alias("revenue_before"))
    return g.withColumn("change_pct", _growth("revenue_now", "revenue_before"))


def customer_declines(fact: DataFrame, p: Periods, k: int = 3) -> DataFrame:
    """Customer change over 6 months and its k products with the largest loss."""
    items = six_month_change(fact, p, ["customer_id", "product_id"]).withColumn("loss", F.col("revenue_before") - F.col("revenue_now")).filter(F.col("loss") > 0)
    best = top_k(items, ["customer_id"], [F.desc("loss"), F.asc("product_id")], k).groupBy("customer_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "product_id"))), lambda x: x["product_id"].cast("string")), ";").alias("declining_products")
    )
    return six_month_change(fact, p, ["customer_id"]).join(best, "customer_id", "left")


def owner_diagnosis(profile: DataFrame, k: int = 2, scores=("absolute", "retention", "category", "pricing", "acquisition", "activation", "upgrade", "mix", "diversification")) -> DataFrame:
    """The k capabilities of each owner furthest below the team mean."""
    long = profile.select("owner", *scores).unpivot(["owner"], list(scores), "capability", "score")
    mean = long.groupBy("capability").agg(F.avg("score").alias("team_mean"))
    d = long.join(mean, "capability").withColumn("gap", F.col("score") - F.col("team_mean"))
    return top_k(d, ["owner"], [F.asc("gap"), F.asc("capability")], k)


def owner_customer_matrix(fact: DataFrame, p: Periods, k: int = 33) -> DataFrame:
    """Profit and revenue of each owner with the k largest customers (long form; the grid is a presentation pivot)."""
    y = fact.filter(p.last12())
    top = y.groupBy("customer_id").agg(F.sum("revenue").alias("v")).orderBy(F.desc("v"), F.asc("customer_id")).limit(k).select("customer_id")
    g = y.join(top, "customer_id", "left_semi").groupBy("owner", "customer_id").agg(dbl(F.sum("profit")).alias("profit"), dbl(F.sum("revenue")).alias("revenue"))
    t = g.groupBy("customer_id").agg(F.sum("revenue").alias("_t"))
    return g.join(t, "customer_id").select("owner", "customer_id", "profit", "revenue", div("revenue", "_t").alias("share"))


def monthly_kpi(fact: DataFrame) -> DataFrame:
    """Monthly totals and distinct counts. The fact is summed to customer months first, so that the several distinct counts
    multiply those rows and not the fact; products are counted beside them."""
    tiers = ("KA", "AA", "KM", "MM")
    products = fact.groupBy(F.col("month_idx").alias("_m")).agg(F.count_distinct("product_id").alias("products"))
    months = fact.groupBy("month_idx", "customer_id", "tier").agg(*[F.sum(m).alias(m) for m in M3]).groupBy("month_idx").agg(
        *[dbl(F.sum(m)).alias(m) for m in M3], F.count_distinct("customer_id").alias("customers"),
        *[total_if(F.col("tier") == t, "revenue").alias(f"revenue_{t.lower()}") for t in tiers], *[distinct_if(F.col("tier") == t, "customer_id").alias(f"customers_{t.lower()}") for t in tiers],
    )
    return months.join(products, F.col("month_idx").eqNullSafe(F.col("_m"))).drop("_m")


def customer_month_cells(cm: DataFrame) -> DataFrame:
    return cm.select("customer_id", "month_idx", *[dbl(m).alias(m) for m in M3], _margin("profit", "revenue").alias("margin"))


def group_margins(fact: DataFrame, p: Periods, group: str, floor: float = 10_000, k: int | None = None) -> DataFrame:
    """YTD margin of a group with its key-account part; groups above a revenue floor, optionally the k largest."""
    key = F.col("tier").isin("KA", "AA")
    g = fact.filter(p.ytd()).groupBy(group).agg(
        dbl(F.sum("revenue")).alias("revenue"), dbl(F.sum("profit")).alias("profit"), total_if(key, "revenue").alias("key_revenue"), total_if(key, "profit").alias("key_profit")
    ).filter(F.col("revenue") >= floor)
    g = g.select(group, "revenue", "profit", _margin("profit", "revenue").alias("margin"), "key_revenue", _margin("key_profit", "key_revenue").alias("key_margin"))
    return g.orderBy(F.desc("revenue"), F.asc(group)).limit(k) if k else g


def first_bulk(fact: DataFrame, bulk: float = 6000.0) -> DataFrame:
    """First month in which a customer-product pair has a row of bulk size, with that month's bulk sums and owners."""
    keys = ["customer_id", "product_id"]
    b = fact.filter(F.col("qty") >= bulk)
    g = b.groupBy(*keys, "month_idx").agg(*[F.sum(m).alias(m) for m in M3], F.array_join(F.array_sort(F.collect_set("owner")), ", ").alias("owners"))
    return top_k(g, keys, [F.asc("month_idx")], 1, "_r").select(*keys, "month_idx", *[dbl(m).alias(m) for m in M3], "owners", _margin("profit", "revenue").alias("margin"))


def owner_month_movers(fact: DataFrame, k: int = 3, limit: float = 50.0) -> DataFrame:
    """Owner x month: sums, new share, largest customer by revenue, and the k customers that moved most month on month."""
    om = ["owner", "month_idx"]
    g = fact.groupBy(*om).agg(*[dbl(F.sum(m)).alias(m) for m in M3], F.count_distinct("customer_id").alias("customers"), total_if(F.col("is_new"), "revenue").alias("new_revenue"))
    oc = fact.groupBy(*om, "customer_id").agg(F.sum("revenue").alias("r"))
    best = top_k(oc, om, [F.desc("r"), F.asc("customer_id")], 1, "_r").select(*om, F.col("customer_id").alias("top_customer"), dbl("r").alias("top_revenue"))
    first = fact.agg(F.min("month_idx")).scalar()
    prev = F.coalesce(at_lag("r", ["owner", "customer_id"], "month_idx", 1), F.lit(0))
    mv = oc.select(*om, "customer_id", dbl("r").alias("r"), dbl(prev).alias("p")).filter(F.col("month_idx") > first)
    chg = F.when(F.col("p") > 0, (F.col("r") - F.col("p")) / F.nullif(F.col("p"), F.lit(0.0)) * 100).when(F.col("r") > 0, 0.0)
    mv = mv.withColumn("chg", chg).filter(((F.col("p") > 0) & (F.abs("chg") > limit)) | ((F.col("p") <= 0) & (F.col("r") > 0)))
    top = top_k(mv, om, [F.desc(F.abs("chg")), F.asc("customer_id")], k).groupBy(*om).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "customer_id"))), lambda x: x["customer_id"].cast("string")), ";").alias("movers")
    )
    return g.join(best, om, "left").join(top, om, "left").withColumn("margin", _margin("profit", "revenue")).withColumn("new_share", F.when(F.col("revenue") > 0, F.col("new_revenue") / F.nullif(F.col("revenue"), F.lit(0.0)) * 100).otherwise(0.0))


def four_dimension_months(fact: DataFrame, k: int = 10) -> DataFrame:
    """Month rows of lines, KA customers, AA customers and the k largest categories in one long table."""
    def part(name, rows, col):
        return rows.groupBy(F.lit(name).alias("dimension"), F.col(col).cast("string").alias("member"), "month_idx").agg(*[dbl(F.sum(m)).alias(m) for m in M3])
    top = fact.groupBy("category").agg(F.sum("revenue").alias("v")).orderBy(F.desc("v"), F.asc("category")).limit(k).select("category")
    return union_all([
        part("line", fact, "product_line"), part("ka_customer", fact.filter(F.col("tier") == "KA"), "customer_id"), part("aa_customer", fact.filter(F.col("tier") == "AA"), "customer_id"),
        part("category", fact.join(top, "category", "left_semi"), "category"),
    ])


def three_windows(fact: DataFrame, p: Periods, dims) -> DataFrame:
    """Current half, previous half and same half last year per dimension: revenue, margin and differences."""
    aggs = []
    for n, back in (("cur", 0), ("prev", 1), ("ly", 2)):
        aggs += _measures(p.half(back), n)
    g = fact.filter((F.col("month_idx") >= p.half_start - 12) & (F.col("month_idx") <= p.half_start + 5))
    g = g.groupBy(*dims).agg(*aggs) if dims else g.agg(*aggs)
    g = g.select("*", *[_margin(f"profit_{n}", f"revenue_{n}").alias(f"margin_{n}") for n in ("cur", "prev", "ly")], *[div(f"revenue_{n}", f"qty_{n}").alias(f"asp_{n}") for n in ("cur", "prev", "ly")])
    return g.select(
        *dims, "revenue_cur", "revenue_prev", "revenue_ly", "profit_cur", "margin_cur", "asp_cur", (F.col("margin_cur") - F.col("margin_prev")).alias("margin_hoh"), (F.col("margin_cur") - F.col("margin_ly")).alias("margin_yoy"),
        _growth("revenue_cur", "revenue_prev").alias("revenue_hoh"), _growth("revenue_cur", "revenue_ly").alias("revenue_yoy"), ((F.col("asp_cur") - F.col("asp_ly")) / F.col("asp_ly") * 100).alias("asp_yoy"),
    ).filter((F.col("revenue_cur") != 0) | (F.col("revenue_ly") != 0) | (F.col("revenue_prev") != 0))


def window_anchor(fact: DataFrame, p: Periods) -> DataFrame:
    """Last month with data in the current half and the month before it if still inside, else NULL."""
    m = fact.filter(p.half()).agg(F.max("month_idx").alias("anchor"))
    return m.select("anchor", F.when(F.col("anchor") - 1 >= p.half_start, F.col("anchor") - 1).alias("anchor_prev"))


def key_account_halves(fact: DataFrame, p: Periods) -> DataFrame:
    """Key accounts in the current half: three-window margins, MoM inside the window, new-product share."""
    k = fact.filter(F.col("tier").isin("KA", "AA"))
    a = window_anchor(k, p).select(F.struct("anchor", "anchor_prev").alias("a")).scalar()
    m = k.filter(p.half()).withColumn("_a", a).groupBy("customer_id").agg(
        total_if(F.col("month_idx") == F.col("_a.anchor"), "revenue").alias("_m0"), total_if(F.col("month_idx") == F.col("_a.anchor_prev"), "revenue").alias("_m1"), total_if(F.col("is_new"), "revenue").alias("_n")
    )
    t = three_windows(k, p, ["customer_id", "tier"]).filter(F.col("revenue_cur") != 0)
    return t.join(m, "customer_id").withColumn("mom", _growth("_m0", "_m1")).withColumn("new_share", F.when(F.col("revenue_cur") > 0, F.col("_n") / F.nullif(F.col("revenue_cur"), F.lit(0.0)) * 100).otherwise(0.0)).drop("_m0", "_m1", "_n")


def new_product_survival(fact: DataFrame, months: int = 12) -> DataFrame:
    """Per flagged new product: active months, revenue, margin and customers in the 12 months from its first sale."""
    new = fact.filter(F.col("is_new")).select("product_id").distinct()
    f = fact.join(new, "product_id", "left_semi")
    first = f.groupBy("product_id").agg(F.min("ship_date").alias("first_date"))
    w = f.join(first, "product_id").filter(F.col("ship_date") <= F.add_months("first_date", months))
    g = w.groupBy("product_id", "first_date").agg(F.count_distinct("month_idx").alias("active_months"), dbl(F.sum("revenue")).alias("revenue"), dbl(F.sum("profit")).alias("profit"), F.count_distinct("customer_id").alias("customers"))
    return g.select("product_id", "first_date", "active_months", (F.col("active_months") / 12.0 * 100).alias("survival"), "revenue", _margin("profit", "revenue").alias("margin"), "customers")


def margin_attribution(fact: DataFrame, p: Periods, keys, min_revenue: float = 5000.0, known: float = 1000.0) -> DataFrame:
    """Margin change of each item against the same half last year and its impact on profit."""
    t = three_windows(fact, p, [*keys, "product_id"]).filter(F.col("revenue_cur") >= min_revenue)
    return t.select(
        *keys, "product_id", "revenue_cur", "margin_cur", "revenue_ly", (F.col("margin_cur") - F.col("margin_yoy")).alias("margin_ly"), F.col("margin_yoy").alias("margin_change"),
        (F.col("revenue_ly") < known).alias("is_new_item"), (F.col("revenue_cur") * F.col("margin_yoy") / 100).alias("impact"),
    )


def margin_issues(fact: DataFrame, p: Periods, min_revenue: float = 1_000_000.0) -> DataFrame:
    """Lines down over 2 points, departments 3 points under the company, key accounts down over 3 points with the cause."""
    big = F.col("revenue_cur") > min_revenue
    line = three_windows(fact, p, ["product_line"]).filter((F.col("margin_yoy") < -2) & big)
    company = three_windows(fact, p, []).agg(F.max("margin_cur")).scalar()
    dept = three_windows(fact, p, ["region"]).withColumn("_c", company).filter((F.col("margin_cur") < F.col("_c") - 3) & big)
    key = fact.filter(F.col("tier").isin("KA", "AA"))
    cust = three_windows(key, p, ["customer_id"]).filter((F.col("margin_yoy") < -3) & big)
    att = margin_attribution(key.join(cust.select("customer_id"), "customer_id", "left_semi"), p, ["customer_id"]).join(cust.select("customer_id", F.col("margin_cur").alias("_m")), "customer_id")
    n = att.groupBy("customer_id").agg(count_if((F.col("margin_change") < -3) & ~F.col("is_new_item")).alias("pd"), count_if(F.col("is_new_item") & (F.col("margin_cur") < F.col("_m"))).alias("nl"))
    cause = cases((F.coalesce("pd", F.lit(0)) >= F.coalesce("nl", F.lit(0)), "price"), (F.col("nl") > 0, "mix"), default="mixed")
    row = lambda df, kind, col, cause_: df.select(F.lit(kind).alias("issue"), F.col(col).cast("string").alias("target"), "revenue_cur", "margin_cur", "margin_yoy", cause_.alias("cause"))
    none = F.lit(None).cast("string")
    return union_all([row(line, "line_margin_down", "product_line", none), row(dept, "department_margin_low", "region", none), row(cust.join(n, "customer_id", "left"), "key_account_margin_down", "customer_id", cause)])


def product_halves(fact: DataFrame, p: Periods, floor: float = 100_000.0, k: int = 5) -> DataFrame:
    """Products above a 12-month revenue floor: three windows, 24-month trend, k largest customers, new tag."""
    f12 = fact.filter(p.last12())
    big = f12.groupBy("product_id").agg(dbl(F.sum("revenue")).alias("revenue_12m"), F.bool_or("is_new").alias("is_new")).filter(F.col("revenue_12m") > floor)
    f = fact.join(big.select("product_id"), "product_id", "left_semi")
    trend = f.filter(within(p.latest, 24)).groupBy("product_id", "month_idx").agg(dbl(F.sum("revenue")).alias("r")).groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("month_idx", "r"))).alias("trend"))
    c12 = f.filter(p.last12()).groupBy("product_id", "customer_id").agg(F.sum("revenue").alias("v"))
    best = top_k(c12, ["product_id"], [F.desc("v"), F.asc("customer_id")], k).groupBy("product_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "customer_id"))), lambda x: x["customer_id"].cast("string")), ";").alias("top_customers")
    )
    return big.join(three_windows(f, p, ["product_id"]), "product_id", "left").join(best, "product_id", "left").join(trend.select("product_id", F.size("trend").alias("trend_months"), "trend"), "product_id", "left")


def geography(fact: DataFrame, p: Periods, dims=("region",), k: int = 5) -> DataFrame:
    """12-month revenue, profit, share, MoM and the k largest customers and lines of each place."""
    f = fact.filter(p.last12())
    g = f.groupBy(*dims).agg(dbl(F.sum("revenue")).alias("revenue"), dbl(F.sum("profit")).alias("profit"), F.count_distinct("customer_id").alias("customers"), *_measures(p.month_at(0), "m0", ("revenue",)), *_measures(p.month_at(1), "m1", ("revenue",)))
    total = f.agg(dbl(F.sum("revenue"))).scalar()

    def best(col, out):
        t = top_k(f.groupBy(*dims, col).agg(F.sum("revenue").alias("v")), dims, [F.desc("v"), F.asc(col)], k)
        return t.groupBy(*dims).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(col).cast("string").alias("x")))), lambda x: x["x"]), ";").alias(out))

    g = g.withColumn("_t", total).select(*dims, "revenue", "profit", "customers", _margin("profit", "revenue").alias("margin"), (div("revenue", "_t") * 100).alias("share"), _growth("revenue_m0", "revenue_m1").alias("mom"))
    return g.join(best("customer_id", "top_customers"), list(dims), "left").join(best("product_line", "top_lines"), list(dims), "left")


def place_rows(fact: DataFrame, province: str, unknown: str = "unknown", rest: str = "unspecified") -> DataFrame:
    """Fact rows once for each place they count for: their province, their city where it is `province`, or their place abroad."""
    row = lambda level, region, sub: F.struct(F.lit(level).alias("level"), region.alias("region"), sub.alias("sub"))
    region, sub, none = F.col("region"), F.col("sub"), F.lit("")
    home = F.array(row("province", region, none), F.when(region == province, row("city", region, F.coalesce(F.nullif(sub, none), F.lit(rest)))))
    levels = F.when(F.col("abroad") | (region == unknown), F.array(row("abroad", region, sub))).otherwise(F.array_compact(home))
    return fact.withColumn("_at", F.explode(levels)).drop("region", "sub", "abroad").select("*", "_at.*").drop("_at")


PLACE = ["level", "region", "sub"]


def place_report(fact: DataFrame, p: Periods, province: str) -> DataFrame:
    """12-month figures of provinces, cities of one province and places abroad: share, latest change and the trend by month."""
    f = place_rows(fact.filter(p.last12()), province)
    months = f.groupBy(*PLACE, "month_idx").agg(*[dbl(F.sum(m)).alias(m) for m in M3])
    trend = F.array(*[total_if(p.month_at(11 - i), "revenue") for i in range(12)]).alias("trend")
    g = months.groupBy(*PLACE).agg(*[F.sum(m).alias(m) for m in M3], *_measures(p.month_at(0), "m0", ("revenue",)), *_measures(p.month_at(1), "m1", ("revenue",)), trend)
    buyers = f.select(*PLACE, "customer_id").distinct().groupBy(*PLACE).agg(F.count("customer_id").alias("customers"))
    total = fact.filter(p.last12()).agg(dbl(F.sum("revenue"))).scalar()
    g = g.join(buyers, PLACE).withColumn("_t", total)
    return g.select(*PLACE, *M3, "customers", _margin("profit", "revenue").alias("margin"), (div("revenue", "_t") * 100).alias("share"), _growth("revenue_m0", "revenue_m1").alias("mom"), "trend")


def place_leaders(fact: DataFrame, p: Periods, province: str, what: str, k: int = 5) -> DataFrame:
    """The k customers or products with the highest revenue of the year so far in each place, with margin and yearly change."""
    f = place_rows(fact.filter(p.ytd() | p.ytd(1)), province).filter(F.col(what).isNotNull())
    g = f.groupBy(*PLACE, what).agg(*_measures(p.ytd(), "now", ("revenue", "profit")), *_measures(p.ytd(1), "before", ("revenue",)), F.max(F.when(p.ytd(), 1)).alias("_sold"))
    g = top_k(g.filter(F.col("_sold") == 1), PLACE, [F.desc("revenue_now"), F.asc(what)], k)
    return g.select(*PLACE, "rank", what, F.col("revenue_now").alias("revenue"), _margin("profit_now", "revenue_now").alias("margin"), _growth("revenue_now", "revenue_before").alias("yoy"))


def place_kpis(fact: DataFrame, p: Periods, province: str, unknown: str = "unknown") -> DataFrame:
    """Year-to-date shares of one province, of places abroad and of unknown ones; the number of provinces."""
    home = ~F.col("abroad") & (F.col("region") != unknown)
    f = fact.filter(p.ytd())
    sums = {"province": home & (F.col("region") == province), "abroad": F.col("abroad"), "unknown": F.col("region") == unknown}
    g = f.agg(dbl(F.sum("revenue")).alias("_t"), *[total_if(c_, "revenue").alias(f"{n}_revenue") for n, c_ in sums.items()], distinct_if(home, "region").alias("provinces"))
    return g.select(*[f"{n}_revenue" for n in sums], *[(div(f"{n}_revenue", "_t") * 100).alias(f"{n}_share") for n in sums], "provinces")


def top_products(fact: DataFrame, p: Periods, k: int = 20) -> DataFrame:
    """The k products with the highest latest-month revenue, their changes, top customer share, and a total row."""
    conds = {"m0": p.month_at(0), "m1": p.month_at(1), "m12": p.month_at(12), "ytd": p.ytd(), "py": p.ytd(1)}
    f = fact.filter(F.col("month_idx") > p.year * 12 - 12)
    g = f.groupBy("product_id").agg(*[a for n, cd in conds.items() for a in _measures(cd, n, ("revenue", "profit"))])
    top = g.filter(F.col("revenue_m0") > 0).orderBy(F.desc("revenue_m0"), F.asc("product_id")).limit(k)
    cust = f.filter(conds["m0"]).join(top.select("product_id"), "product_id", "left_semi").groupBy("product_id", "customer_id").agg(dbl(F.sum("revenue")).alias("v"))
    best = top_k(cust, ["product_id"], [F.desc("v"), F.asc("customer_id")], 1, "_r").select("product_id", F.col("customer_id").alias("top_customer"), F.col("v").alias("_v"))
    names = [f"{m}_{n}" for n in conds for m in ("revenue", "profit")]
    rows = top.join(best, "product_id", "left")
    total = rows.agg(*[F.sum(n).alias(n) for n in names]).select(F.lit(None).cast("bigint").alias("product_id"), *names, F.lit(None).cast("bigint").alias("top_customer"), F.lit(None).cast("double").alias("_v"))
    return rows.unionByName(total).select(
        "product_id", "revenue_m0", _growth("revenue_m0", "revenue_m1").alias("mom"), _growth("revenue_m0", "revenue_m12").alias("yoy"), "revenue_ytd", _growth("revenue_ytd", "revenue_py").alias("ytd_yoy"),
        _margin("profit_m0", "revenue_m0").alias("margin"), (_margin("profit_m0", "revenue_m0") - _margin("profit_m1", "revenue_m1")).alias("margin_change"), "top_customer", (div("_v", "revenue_m0") * 100).alias("top_customer_share"),
    )


# --- datasets of the product portrait ------------------------------------------------------------------------


def history_series(history: DataFrame, k: int = 12) -> DataFrame:
    t = top_k(history, ["product_id"], [F.desc("as_of")], k)
    return t.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("as_of", "portrait", "margin", F.col("r12_q").alias("qty")))).alias("series"))


def monthly_series(pm: DataFrame, latest: int, months: int = 12) -> DataFrame:
    """Quantity and margin of every month slot of the last 12; a month without data is NULL."""
    slots = F.explode(F.sequence(F.lit(latest - months + 1).cast("int"), F.lit(latest).cast("int")))
    recent = pm.filter(within(latest, months)).select("product_id", "month_idx", dbl("qty").alias("qty"), _margin("profit", "revenue").alias("margin"))
    dense = recent.select("product_id").distinct().select("product_id", slots.alias("month_idx"))
    return dense.join(recent, ["product_id", "month_idx"], "left")


def portrait_migration(history: DataFrame) -> DataFrame:
    """Counts of moves between a product's modal portraits of one quarter and the next (ties: the latest month's)."""
    q = history.withColumn("quarter", F.floor((F.col("as_of") - 1) / 3).cast("int"))
    n = q.groupBy("product_id", "quarter", "portrait").agg(F.count("*").alias("n"), F.max("as_of").alias("last"))
    m = top_k(n, ["product_id", "quarter"], [F.desc("n"), F.desc("last")], 1, "_r").select("product_id", "quarter", "portrait")
    nxt = F.max("portrait").over(Window.partitionBy("product_id").orderBy("quarter").rangeBetween(1, 1))
    return m.select("quarter", F.col("portrait").alias("from_portrait"), nxt.alias("to_portrait")).filter(F.col("to_portrait").isNotNull()).groupBy("quarter", "from_portrait", "to_portrait").agg(F.count("*").alias("products"))


def distribution_counts(table: DataFrame, cols) -> DataFrame:
    return table.select(*[F.col(x).cast("string").alias(x) for x in cols]).unpivot([], list(cols), "dimension", "value").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def filter_values(table: DataFrame, cols) -> DataFrame:
    long = table.select(*[F.col(x).cast("string").alias(x) for x in cols]).unpivot([], list(cols), "dimension", "value")
    return long.filter(F.col("value").isNotNull()).distinct()


def product_kpi(table: DataFrame) -> DataFrame:
    qty = F.when(F.col("r12_q") > 0, F.col("r12_q"))
    return table.agg(
        F.count("*").alias("products"), count_if(F.col("risk_level").isin("high", "very_high")).alias("high_risk"), count_if(F.col("portrait").isin("decline", "sunset", "hidden_decline")).alias("declining"),
        count_if(F.col("portrait").isin("growth", "healthy_expansion")).alias("growing"), (F.sum(F.col("margin") * qty) / F.sum(qty)).alias("weighted_margin"), F.avg("growth").alias("mean_growth"),
    )
