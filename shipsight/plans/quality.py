"""Cleaning, data quality, joins, sorts and window studies."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.core import dbl, div, top_k, within
from ..operators import cleaning
from ..operators import quality as ops
from ..operators import trend
from .datasets import KEY, Y
from .registry import cte, query
from .sqlbits import LM, clip, cnt, d, ratio, tot, win

ROWS = ("order_id", "line_no", "customer_id", "product_id", "ship_date", "month_idx")
_k = "order_id, line_no, product_id"


def _lines(w, *extra):
    return w.fact("order_id", "line_no", "product_id", *extra)


query("c01_rename_columns", f"SELECT {_k}, revenue AS amount FROM fact", "amount")(lambda w: cleaning.rename_columns(_lines(w, "revenue"), {"revenue": "amount", "absent": "x"}).withColumn("amount", dbl("amount")))
query("c02_drop_superseded", f"SELECT {_k}, revenue FROM fact", "revenue")(lambda w: cleaning.drop_superseded(_lines(w, "revenue", "cost"), ["cost", "absent"]).withColumn("revenue", dbl("revenue")))
_RM = f"SELECT {_k}, {ratio('profit', 'revenue')} AS row_margin, "
query("c03_row_margin", _RM + f"{d('profit')} AS profit_used FROM fact", "row_margin profit_used")(lambda w: cleaning.row_margin(_lines(w, "revenue", "profit")).drop("revenue", "profit"))
query("c04_margin_clip", _RM + f"CASE WHEN revenue > 0 THEN {clip(ratio('profit', 'revenue'), -0.5, 0.75)}*{d('revenue')} ELSE {d('profit')} END AS profit_used FROM fact", "row_margin profit_used")(
    lambda w: cleaning.row_margin(_lines(w, "revenue", "profit"), apply_clip=True).drop("revenue", "profit")
)
query("c05_returns_filter", f"SELECT {_k}, {d('qty')} AS qty FROM fact WHERE qty > 0", "qty")(lambda w: cleaning.handle_returns(_lines(w, "qty"), strict=True).withColumn("qty", dbl("qty")))


@query("c06_date_coercion", f"SELECT {_k}, ship_date FROM fact WHERE line_no <> 3")
def _c06(w):
    text = F.when(F.col("line_no") == 3, F.lit("not a date")).otherwise(F.col("ship_date").cast("string"))
    return cleaning.coerce_date(_lines(w, "ship_date").withColumn("ship_date", text), "ship_date")


query("c07_date_window", f"SELECT {_k}, ship_date FROM fact WHERE ship_date >= DATE '2000-01-01'")(lambda w: cleaning.date_window(_lines(w, "ship_date"), "ship_date", __import__("datetime").date(2000, 1, 1)))
query("c08_incomplete_month", f"SELECT {_k}, ship_date FROM fact WHERE month_idx < {LM}")(lambda w: cleaning.trim_incomplete_month(_lines(w, "ship_date")))


@query("c09_key_sentinel", "SELECT customer_key, count(*) AS rows FROM (SELECT CASE WHEN customer_id % 7 = 0 THEN 'unknown' ELSE CAST(customer_id AS VARCHAR) END AS customer_key FROM fact) WHERE customer_key <> 'unknown' GROUP BY 1")
def _c09(w):
    r = w.fact("customer_id").withColumn("customer_key", F.when(F.col("customer_id") % 7 != 0, F.col("customer_id").cast("string")))
    return cleaning.drop_sentinels(cleaning.fill_key(r, "customer_key", "unknown"), "customer_key", ["unknown"]).groupBy("customer_key").agg(F.count("*").alias("rows"))


query("c10_customer_info", "SELECT customer_id, tier, owner, CASE tier WHEN 'KA' THEN 'A' WHEN 'AA' THEN 'A' WHEN 'KM' THEN 'B' WHEN 'MM' THEN 'C' ELSE 'unknown' END AS grade FROM cust")(lambda w: cleaning.customer_info(w.fact("customer_id", "tier", "owner", "ship_date", "order_id", "line_no")))


@query("c11_required_columns", "SELECT 'silver' AS stage, 'required' AS \"check\", 'address' AS \"column\", CAST(1 AS BIGINT) AS bad, FALSE AS passed UNION ALL SELECT 'silver', 'not_empty', '*', CAST((SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM fact) AS BIGINT), TRUE")
def _c11(w):
    return ops.staged_validation(w.fact("customer_id", "revenue"), "silver", ["customer_id", "address"])


query("c12_null_rates", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) AS null_rate, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) <= 0.01 AS passed FROM fact" for c in ("customer_id", "product_line", "revenue")), "null_rate")(
    lambda w: ops.null_rates(w.fact("customer_id", "product_line", "revenue"), ["customer_id", "product_line", "revenue"], 0.01)
)
query("c13_value_ranges", f"SELECT 'qty' AS \"column\", {cnt('qty < 0')} AS below, {cnt('qty > 40')} AS above, {d('min(qty)')} AS minimum, {d('max(qty)')} AS maximum, {cnt('qty < 0 OR qty > 40')} = 0 AS passed FROM fact UNION ALL SELECT 'revenue', {cnt('revenue < 0')}, 0, {d('min(revenue)')}, {d('max(revenue)')}, {cnt('revenue < 0')} = 0 FROM fact", "minimum maximum")(
    lambda w: ops.value_ranges(w.fact("qty", "revenue"), {"qty": (0, 40), "revenue": (0, None)})
)
query("c14_category_values", "SELECT tier AS value, count(*) AS rows FROM fact WHERE tier NOT IN ('KA','AA') GROUP BY 1")(lambda w: ops.category_values(w.fact("tier"), "tier", ["KA", "AA"]))


@query("c15_staged_validation", f"""SELECT 'clean' AS stage, 'null' AS "check", 'customer_id' AS "column", {cnt('customer_id IS NULL')} AS bad, TRUE AS passed FROM fact UNION ALL SELECT 'clean', 'range', 'qty', {cnt('qty < 0')}, {cnt('qty < 0')} = 0 FROM fact
  UNION ALL SELECT 'clean', 'category', 'tier', {cnt("tier NOT IN ('KA','AA','KM','MM')")}, TRUE FROM fact UNION ALL SELECT 'clean', 'not_empty', '*', 0, TRUE""")
def _c15(w):
    return ops.staged_validation(w.fact("customer_id", "qty", "tier"), "clean", ["customer_id", "qty", "tier"], {"customer_id": 0.0}, {"qty": (0, None)}, {"tier": ["KA", "AA", "KM", "MM"]})


query("c16_cleaning_summary", f"""SELECT 'rows' AS "check", count(*) AS n FROM fact UNION ALL SELECT 'returns', {cnt('qty <= 0')} FROM fact UNION ALL SELECT 'loss_rows', {cnt('profit < 0')} FROM fact UNION ALL SELECT 'customers_after', count(DISTINCT customer_id) FILTER (WHERE qty > 0) FROM fact""")(
    lambda w: ops.cleaning_summary(w.fact("qty", "profit", "customer_id"), {"rows": "count(*)", "returns": "count_if(qty <= 0)", "loss_rows": "count_if(profit < 0)", "customers_after": F.count_distinct(F.when(F.col("qty") > 0, F.col("customer_id")))})
)


@query("c17_line_backfill", f"SELECT order_id, line_no, product_id, coalesce(CASE WHEN line_no <> 2 THEN product_line END, b.l, 'unclassified') AS product_line, CASE WHEN line_no <> 2 THEN 'source' WHEN b.l IS NOT NULL THEN 'same_product' ELSE 'default' END AS line_source FROM fact LEFT JOIN (SELECT product_id, min(product_line) AS l FROM fact WHERE line_no <> 2 GROUP BY 1) b USING (product_id)")
def _c17(w):
    r = _lines(w, "product_line").withColumn("product_line", F.when(F.col("line_no") != 2, F.col("product_line")))
    return cleaning.backfill_line(r)


_CF = "CASE WHEN order_id % 50 = 0 THEN 'Brand#X' ELSE product_line END"


@query("c18_line_conflicts", f"SELECT product_id, count(*) AS lines, CAST(sum(n) AS BIGINT) AS rows, string_agg(l || ':' || n, '; ' ORDER BY l) AS candidates FROM (SELECT product_id, {_CF} AS l, count(*) AS n FROM fact GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1")
def _c18(w):
    r = w.fact("product_id", "order_id", "product_line").withColumn("product_line", F.when(F.col("order_id") % 50 == 0, "Brand#X").otherwise(F.col("product_line")))
    return cleaning.line_conflicts(r)


@query("c19_key_fallback", "SELECT customer_id, customer_id_source, count(*) AS rows FROM (SELECT CASE WHEN line_no = 1 THEN CAST(order_id AS VARCHAR) WHEN line_no = 2 THEN owner ELSE 'unknown' END AS customer_id, CASE WHEN line_no = 1 THEN 'end_customer' WHEN line_no = 2 THEN 'agent' ELSE 'default' END AS customer_id_source FROM fact) GROUP BY 1, 2")
def _c19(w):
    r = w.fact("order_id", "line_no", "owner").select(F.when(F.col("line_no") == 1, F.col("order_id").cast("string")).otherwise(F.lit("  ")).alias("end_customer"), F.when(F.col("line_no") == 2, F.col("owner")).alias("agent"))
    return cleaning.key_fallback(r, ["end_customer", "agent"]).groupBy("customer_id", "customer_id_source").agg(F.count("*").alias("rows"))


_CH = "CASE WHEN line_no = 7 THEN 'web' WHEN line_no = 6 THEN NULL ELSE channel END"


@query("c20_channel_report", f"""WITH f AS (SELECT customer_id, month_idx, revenue, {_CH} AS ch, CASE WHEN line_no <> 5 THEN owner END AS agent FROM fact) SELECT 'non_standard' AS issue, {cnt("ch = 'web'")} AS n FROM f UNION ALL SELECT 'missing', {cnt('ch IS NULL')} FROM f UNION ALL SELECT 'distributor_without_agent', {cnt("ch = 'distributor' AND agent IS NULL")} FROM f
  UNION ALL SELECT 'both_channels', count(*) FROM (SELECT customer_id FROM f WHERE ch IN ('direct','distributor') GROUP BY 1 HAVING count(DISTINCT ch) > 1) UNION ALL SELECT 'months_over_limit', count(*) FROM (SELECT month_idx FROM f GROUP BY 1 HAVING {ratio("sum(revenue) FILTER (WHERE ch = 'web' OR ch IS NULL)", 'sum(revenue)')} > 0.05)""")
def _c20(w):
    r = w.fact("customer_id", "month_idx", "revenue", "channel", "line_no", "owner")
    r = r.withColumn("channel", F.when(F.col("line_no") == 7, "web").when(F.col("line_no") != 6, F.col("channel"))).withColumn("agent", F.when(F.col("line_no") != 5, F.col("owner")))
    return ops.channel_report(r)


query("c21_tier_anomalies", f"SELECT tier, count(*) AS rows, {d('sum(revenue)')} AS revenue, count(DISTINCT customer_id) AS customers FROM fact WHERE tier NOT IN ('KA','AA') GROUP BY 1", "revenue")(lambda w: ops.tier_anomalies(w.fact("tier", "customer_id", "revenue"), allowed=("KA", "AA"))[0])
query("c21_tier_anomaly_customers", f"SELECT customer_id, {d('sum(revenue)')} AS revenue FROM fact WHERE tier NOT IN ('KA','AA') GROUP BY 1 ORDER BY sum(revenue) DESC, customer_id LIMIT 30", "revenue")(lambda w: ops.tier_anomalies(w.fact("tier", "customer_id", "revenue"), allowed=("KA", "AA"))[1])


def _profile_sql(cols) -> str:
    return f"SELECT 'fact' AS \"table\", 'rows' AS measure, '*' AS \"column\", {d('count(*)')} AS value FROM fact UNION ALL SELECT 'fact', 'columns', '*', {len(cols)} " + "".join(
        f" UNION ALL SELECT 'fact', 'sum', '{c}', {d(f'sum({c})')} FROM fact UNION ALL SELECT 'fact', 'nulls', '{c}', {d(cnt(f'{c} IS NULL'))} FROM fact" for c in cols)


query("c22_table_profile", _profile_sql(["customer_id", "revenue", "qty"]), "value")(lambda w: ops.table_profile(w.fact("customer_id", "revenue", "qty"), "fact").filter(F.col("measure") != "schema"))


@query("c23_profile_drift", f"SELECT 'fact' AS \"table\", 'rows' AS measure, '*' AS \"column\", {d('count(*)')} AS base_value, {d(cnt('qty > 0'))} AS current_value, 'changed' AS drift FROM fact UNION ALL SELECT 'fact', 'sum', 'qty', {d('sum(qty)')}, {d('sum(qty) FILTER (WHERE qty > 0)')}, 'changed' FROM fact", "base_value current_value")
def _c23(w):
    f = w.fact("qty")
    return ops.profile_drift(ops.table_profile(f, "fact"), ops.table_profile(f.filter(F.col("qty") > 0), "fact"))


def _imp(name, keep, clp):
    p = f"CASE WHEN revenue > 0 THEN {clip(ratio('profit', 'revenue'), -0.5, 0.75)}*{d('revenue')} ELSE {d('profit')} END" if clp else d("profit")
    return f"SELECT '{name}' AS scenario, count(*) AS rows, {d('sum(revenue)')} AS revenue, {d(f'sum(CAST(round({p}, 4) AS DECIMAL(28,4)))')} AS profit FROM fact WHERE month_idx > {Y}*12 {'' if keep else 'AND qty > 0'}"


_IMP = " UNION ALL ".join([_imp("keep_raw", 1, 0), _imp("keep_clip", 1, 1), _imp("drop_raw", 0, 0), _imp("drop_clip", 0, 1)])


@query("c24_clean_rule_impact", f"SELECT s.*, s.revenue - b.revenue AS revenue_diff, s.profit - b.profit AS profit_diff, s.profit/s.revenue*100 AS margin FROM ({_IMP}) s, ({_imp('b', 1, 0)}) b", "revenue profit revenue_diff profit_diff margin")
def _c24(w):
    return ops.clean_rule_impact(w.fact("month_idx", "qty", "revenue", "profit", months=12), ((w.latest - 1) // 12) * 12 + 1, w.latest)


@query("c30_scenario_stages", f"""SELECT scenario, mom || '_' || h AS stage, count(*) AS products FROM (SELECT scenario, CASE WHEN g > 0.15 THEN 'up' WHEN g > -0.1 THEN 'flat' ELSE 'down' END AS mom, CASE WHEN mr IS NULL THEN 'unknown' WHEN mr >= ma THEN 'good' WHEN mr >= ma*0.5 THEN 'fair' ELSE 'bad' END AS h FROM (
  SELECT *, CASE WHEN p3 > 0 THEN (l3-p3)/p3 ELSE 0 END AS g FROM (SELECT scenario, product_id, {tot('qty', win(3))} AS l3, {tot('qty', win(3, 3))} AS p3, {ratio(f'sum(profit) FILTER (WHERE {win(3)})', f'sum(revenue) FILTER (WHERE {win(3)})')} AS mr, {ratio('sum(profit)', 'sum(revenue)')} AS ma
  FROM (SELECT 'keep' AS scenario, * FROM fact UNION ALL SELECT 'drop', * FROM fact WHERE qty > 0) GROUP BY 1, 2))) GROUP BY 1, 2""")
def _c30(w):
    return ops.scenario_stages(w.fact("product_id", "month_idx", "qty", "revenue", "profit"), w.latest)


query("c25_axis_bounds", f"SELECT quantile_cont({ratio('profit', 'revenue')}, 0.01) AS low, quantile_cont({ratio('profit', 'revenue')}, 0.99) AS high FROM fact", "low high")(lambda w: ops.axis_bounds(w.fact("revenue", "profit"), div("profit", "revenue")))
query("c31_chart_compression", f"SELECT count(v) AS \"values\", count(*) FILTER (WHERE v < low OR v > high) AS outside, any_value(low) AS low, any_value(high) AS high, {d('count(*) FILTER (WHERE v < low OR v > high)')}/count(v) AS outside_share FROM (SELECT {ratio('profit', 'revenue')} AS v FROM fact), (SELECT quantile_cont({ratio('profit', 'revenue')}, 0.01) AS low, quantile_cont({ratio('profit', 'revenue')}, 0.99) AS high FROM fact)", "low high outside_share")(
    lambda w: ops.compression(w.fact("revenue", "profit"), div("profit", "revenue"))
)
_DEPT = {"ASIA": "east", "EUROPE": "west", "AMERICA": "west"}
query("c28_region_map", "SELECT region, CASE region WHEN 'ASIA' THEN 'east' WHEN 'EUROPE' THEN 'west' WHEN 'AMERICA' THEN 'west' ELSE 'unknown' END AS area, count(*) AS rows FROM fact GROUP BY 1, 2")(lambda w: cleaning.map_region(w.fact("region"), _DEPT, "region", "area").groupBy("region", "area").agg(F.count("*").alias("rows")))


@query("c29_forecast_check", "SELECT CAST(0 AS BIGINT) AS unmatched, 'revenue' AS \"column\", max(abs(CASE WHEN month_idx % 2 = 0 THEN r*1.01 ELSE r END - r)/greatest(abs(r),1)) AS max_diff, FALSE AS passed FROM (SELECT month_idx, CAST(sum(revenue) AS DOUBLE) AS r FROM fact GROUP BY 1)", "max_diff")
def _c29(w):
    m = w.fact("month_idx", "revenue").groupBy("month_idx").agg(dbl(F.sum("revenue")).alias("revenue"))
    return ops.compare_forecasts(m.withColumn("revenue", F.when(F.col("month_idx") % 2 == 0, F.col("revenue") * 1.01).otherwise(F.col("revenue"))), m, ["revenue"])


# --- joins, sorts, sets --------------------------------------------------------------------------------------
query("j01_enrich_rows", "SELECT f.order_id, f.line_no, f.product_id, cust.owner, cust.tier FROM fact f LEFT JOIN cust ON f.customer_id = cust.customer_id")(lambda w: w.fact("order_id", "line_no", "product_id", "customer_id").join(w.customers("owner", "tier"), "customer_id", "left").drop("customer_id"))
query("j04_inner_owner", f"SELECT owner, tier, count(*) AS pairs, {d('sum(revenue)')} AS revenue FROM (SELECT customer_id, product_id, sum(revenue) AS revenue FROM cpm GROUP BY 1, 2) JOIN cust USING (customer_id) GROUP BY 1, 2", "revenue")(
    lambda w: w.fact("customer_id", "product_id", "revenue").groupBy("customer_id", "product_id").agg(F.sum("revenue").alias("revenue")).join(w.customers("owner", "tier"), "customer_id").groupBy("owner", "tier").agg(F.count("*").alias("pairs"), dbl(F.sum("revenue")).alias("revenue"))
)


@query("j02_bridge", f"SELECT customer_id, product_id, month_idx, {d('revenue')} AS revenue, portrait, risk_level, pareto, zone, growth, margin AS product_margin FROM (SELECT customer_id, product_id, month_idx, revenue FROM cpm) LEFT JOIN (SELECT product_id, portrait, risk_level, pareto, zone, growth, margin FROM pp WHERE as_of = {LM}) USING (product_id)", "revenue growth product_margin")
def _j02(w):
    from ..operators import bridge

    return bridge.customer_product_bridge(w.customer_product_month().select("customer_id", "product_id", "month_idx", dbl("revenue").alias("revenue")), w.product_portrait())


_PL = ("growth", "cash_cow", "warning_growth", "hidden_decline", "sunset", "decline")
cte("x_bridge", f"SELECT customer_id, product_id, revenue, portrait, risk_level FROM (SELECT customer_id, product_id, revenue FROM cpm) LEFT JOIN (SELECT product_id, portrait, risk_level FROM pp WHERE as_of = {LM}) USING (product_id)")
_PHS = ", ".join(f"{tot('revenue', f'portrait = {p!r}')} AS {p}" for p in _PL)


@query("a06_portfolio_health", f"SELECT *, CASE WHEN revenue > 0 THEN (warning_growth+hidden_decline+decline)/revenue ELSE 0 END AS declining_share FROM (SELECT customer_id, count(DISTINCT product_id) AS products, {d('sum(revenue)')} AS revenue, {_PHS} FROM x_bridge GROUP BY 1)", "revenue declining_share " + " ".join(_PL))
def _a06(w):
    from ..operators import bridge

    return bridge.portfolio_health(bridge.customer_product_bridge(w.customer_product_month(), w.product_portrait()))


@query("a07_portfolio_pivot", f"SELECT customer_id, revenue, {', '.join(f'{p}/nullif(revenue,0) AS {p}_share' for p in _PL)}, (warning_growth+hidden_decline+decline)/nullif(revenue,0) AS risk_share FROM (SELECT customer_id, {d('sum(revenue)')} AS revenue, {_PHS} FROM x_bridge GROUP BY 1)", "revenue risk_share " + " ".join(f"{p}_share" for p in _PL))
def _a07(w):
    from ..operators import bridge

    return bridge.portfolio_pivot(bridge.customer_product_bridge(w.customer_product_month(), w.product_portrait()))


@query("a08_product_customers", f"SELECT product_id, count(DISTINCT customer_id) AS customers, {d('sum(revenue)')} AS revenue, count(DISTINCT customer_id) FILTER (WHERE lifecycle IN ('decline','sleep','lost')) AS risky_customers FROM cpm LEFT JOIN x_life USING (customer_id) GROUP BY 1", "revenue")
def _a08(w):
    from ..operators import bridge, customer

    return bridge.product_customers(w.customer_product_month(), customer.customer_lifecycle(w.customer_month(), w.latest))


query("j03_line_propagation", "SELECT customer_id, product_id, month_idx, product_line FROM cpm")(lambda w: __import__("shipsight.operators.silver", fromlist=["x"]).with_product_line(w.customer_product_month(), w.fact("product_id", "product_line")).select("customer_id", "product_id", "month_idx", "product_line"))
_PAIR = "SELECT DISTINCT customer_id, product_id FROM fact WHERE "
query("j06_lapsed_pairs", f"{_PAIR}{win(12)} EXCEPT {_PAIR}{win(3)}")(lambda w: (lambda f: f.filter(within(w.latest, 12)).select("customer_id", "product_id").distinct().join(f.filter(within(w.latest, 3)), ["customer_id", "product_id"], "left_anti"))(w.fact("customer_id", "product_id", "month_idx", months=12)))
query("j07_key_account_rows", f"SELECT order_id, line_no, product_id FROM fact WHERE {KEY}")(lambda w: w.fact("order_id", "line_no", "product_id", "customer_id").join(w.customers("tier").filter(F.col("tier").isin("KA", "AA")), "customer_id", "left_semi").drop("customer_id"))
_YOY = "max(revenue) OVER (PARTITION BY product_line ORDER BY month_idx RANGE BETWEEN {0} PRECEDING AND {0} PRECEDING)"


@query("j08_calendar_lookup", f"SELECT product_line, month_idx, revenue, {_YOY.format(1)} AS previous, {_YOY.format(12)} AS year_ago FROM (SELECT product_line, month_idx, {d('sum(revenue)')} AS revenue FROM fact GROUP BY 1, 2)", "revenue previous year_ago")
def _j08(w):
    from ..operators.period import at_lag

    g = w.fact("product_line", "month_idx", "revenue").groupBy("product_line", "month_idx").agg(dbl(F.sum("revenue")).alias("revenue"))
    return g.select("*", at_lag("revenue", ["product_line"], "month_idx", 1).alias("previous"), at_lag("revenue", ["product_line"], "month_idx", 12).alias("year_ago"))


query("k01_stable_order", f"SELECT customer_id, {d('sum(revenue)')} AS revenue FROM fact GROUP BY 1", "revenue")(lambda w: w.fact("customer_id", "revenue").groupBy("customer_id").agg(dbl(F.sum("revenue")).alias("revenue")).orderBy(F.desc("revenue"), F.asc("customer_id")))


@query("k02_severity_order", "SELECT customer_id, severity, CASE severity WHEN 'severe' THEN 0 WHEN 'watch' THEN 1 WHEN 'slight' THEN 2 ELSE 3 END AS severity_rank FROM x_neg")
def _k02(w):
    from ..operators import customer, insights

    n = insights.negative_margin(w.customer_product_month(), customer.momentum(w.customer_month(), w.latest))
    r = F.when(F.col("severity") == "severe", 0).when(F.col("severity") == "watch", 1).when(F.col("severity") == "slight", 2).otherwise(3)
    return n.select("customer_id", "severity", r.alias("severity_rank")).orderBy("severity_rank", "customer_id")


query("k03_top_per_group", f"SELECT product_line, customer_id, {d('v')} AS revenue, rank FROM (SELECT product_line, customer_id, sum(revenue) AS v, row_number() OVER (PARTITION BY product_line ORDER BY sum(revenue) DESC, customer_id) AS rank FROM fact GROUP BY 1, 2) WHERE rank <= 5", "revenue")(
    lambda w: top_k(w.fact("product_line", "customer_id", "revenue").groupBy("product_line", "customer_id").agg(dbl(F.sum("revenue")).alias("revenue")), ["product_line"], [F.desc("revenue"), F.asc("customer_id")], 5)
)
query("k04_global_top", f"SELECT product_id, {d('sum(revenue)')} AS revenue FROM fact WHERE month_idx = {LM} GROUP BY 1 ORDER BY sum(revenue) DESC, product_id LIMIT 20", "revenue")(lambda w: w.fact("product_id", "month_idx", "revenue", months=1).groupBy("product_id").agg(dbl(F.sum("revenue")).alias("revenue")).orderBy(F.desc("revenue"), F.asc("product_id")).limit(20))
query("k06_bottom", f"SELECT product_id, {ratio('sum(profit)', 'sum(revenue)')} AS margin FROM fact GROUP BY 1 ORDER BY margin, product_id LIMIT 50", "margin")(lambda w: w.fact("product_id", "revenue", "profit").groupBy("product_id").agg(div(F.sum("profit"), F.sum("revenue")).alias("margin")).orderBy("margin", "product_id").limit(50))
query("k08_set_operations", "SELECT customer_id, 'both' AS part FROM (SELECT customer_id FROM fact WHERE product_line = 'Brand#1' INTERSECT SELECT customer_id FROM fact WHERE product_line = 'Brand#2') UNION ALL SELECT customer_id, 'only_first' FROM (SELECT customer_id FROM fact WHERE product_line = 'Brand#1' EXCEPT SELECT customer_id FROM fact WHERE product_line = 'Brand#2')")(
    lambda w: (lambda a, b: a.intersect(b).withColumn("part", F.lit("both")).unionByName(a.subtract(b).withColumn("part", F.lit("only_first"))))(*[w.fact("customer_id", "product_line").filter(F.col("product_line") == x).select("customer_id") for x in ("Brand#1", "Brand#2")])
)
query("k09_distinct_pairs", "SELECT DISTINCT product_id, product_line FROM fact")(lambda w: w.fact("product_id", "product_line").distinct())

# --- window functions ----------------------------------------------------------------------------------------
cte("x_trend", f"""SELECT customer_id, month_idx, revenue, CASE WHEN count(*) OVER w3 >= 2 THEN avg(revenue) OVER w3 END AS ma3, CASE WHEN count(*) OVER w6 >= 3 THEN avg(revenue) OVER w6 END AS ma6, CASE WHEN lag(revenue) OVER w > 1 THEN {clip('(revenue - lag(revenue) OVER w)/lag(revenue) OVER w*100', -999.0, 999.0)} END AS mom,
  CASE WHEN max(revenue) OVER wy > 1 THEN {clip('(revenue - max(revenue) OVER wy)/max(revenue) OVER wy*100', -999.0, 999.0)} END AS yoy, CASE WHEN count(*) OVER w6 >= 3 THEN round(regr_slope(revenue, x) OVER w6, 6) END AS slope FROM (SELECT customer_id, month_idx, {d('revenue')} AS revenue, {d('row_number() OVER (PARTITION BY customer_id ORDER BY month_idx)')} AS x FROM cm)
  WINDOW w AS (PARTITION BY customer_id ORDER BY month_idx), w3 AS (PARTITION BY customer_id ORDER BY month_idx ROWS 2 PRECEDING), w6 AS (PARTITION BY customer_id ORDER BY month_idx ROWS 5 PRECEDING), wy AS (PARTITION BY customer_id ORDER BY month_idx RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING)""")
_TRD = "revenue ma3 ma6 mom yoy slope"


@query("w01_revenue_trend", "SELECT *, CASE WHEN slope IS NULL THEN 'unknown' WHEN slope > 0.02 THEN 'up' WHEN slope < -0.02 THEN 'down' ELSE 'flat' END AS direction FROM x_trend", _TRD)
def _w01(w):
    return trend.revenue_trend(w.customer_month())


query("w02_month_on_month", "SELECT customer_id, month_idx, mom FROM x_trend", "mom")(lambda w: trend.revenue_trend(w.customer_month()).select("customer_id", "month_idx", "mom"))
query("w03_year_on_year", "SELECT customer_id, month_idx, yoy FROM x_trend", "yoy")(lambda w: trend.revenue_trend(w.customer_month()).select("customer_id", "month_idx", "yoy"))
query("w04_rolling_slope", "SELECT customer_id, month_idx, slope FROM x_trend", "slope")(lambda w: trend.revenue_trend(w.customer_month()).select("customer_id", "month_idx", "slope"))
query("w05_series_slope", f"SELECT customer_id, CASE WHEN count(*) >= 3 THEN regr_slope(y, x) ELSE 0 END AS slope FROM (SELECT customer_id, {d('revenue')} AS y, {d('row_number() OVER (PARTITION BY customer_id ORDER BY month_idx)')} AS x FROM cm) GROUP BY 1", "slope")(lambda w: trend.series_slope(w.customer_month(), ["customer_id"], "revenue"))


@query("w08_category_migration", f"""SELECT *, share - lag(share) OVER w AS share_change, rank - lag(rank) OVER w AS rank_change FROM (SELECT *, dense_rank() OVER (PARTITION BY customer_id, half ORDER BY revenue DESC) AS rank FROM (SELECT customer_id, half, product_line, {d('v')} AS revenue, {ratio('v', 't')} AS share FROM (
  SELECT *, sum(v) OVER (PARTITION BY customer_id, half) AS t FROM (SELECT customer_id, CAST((month_idx-1)//6 AS INT) AS half, product_line, sum(revenue) AS v FROM cpm GROUP BY 1, 2, 3)) WHERE t > 0) WHERE share >= 0.01) WINDOW w AS (PARTITION BY customer_id, product_line ORDER BY half)""", "revenue share share_change")
def _w08(w):
    return trend.category_migration(w.customer_product_month(extra=("product_line",)))


query("w07_rank_change", "SELECT month_idx, product_line, rank, rank - lag(rank) OVER (PARTITION BY product_line ORDER BY month_idx) AS rank_change FROM (SELECT month_idx, product_line, dense_rank() OVER (PARTITION BY month_idx ORDER BY sum(revenue) DESC) AS rank FROM fact GROUP BY 1, 2)")(
    lambda w: (lambda g: g.select("month_idx", "product_line", "rank", (F.col("rank") - F.lag("rank").over(Window.partitionBy("product_line").orderBy("month_idx"))).alias("rank_change")))(
        w.fact("month_idx", "product_line", "revenue").groupBy("month_idx", "product_line").agg(F.sum("revenue").alias("v")).withColumn("rank", F.dense_rank().over(Window.partitionBy("month_idx").orderBy(F.desc("v"))))
    )
)
query("w13_reverse_index", "SELECT customer_id, month_idx, row_number() OVER (PARTITION BY customer_id ORDER BY month_idx DESC) - 1 AS back FROM cm")(lambda w: w.customer_month().select("customer_id", "month_idx", (F.row_number().over(Window.partitionBy("customer_id").orderBy(F.desc("month_idx"))) - 1).alias("back")))
query("w15_running_mtd", f"SELECT ship_date, {d('sum(r) OVER (PARTITION BY month_idx ORDER BY ship_date)')} AS mtd FROM (SELECT ship_date, month_idx, sum(revenue) AS r FROM fact GROUP BY 1, 2)", "mtd")(
    lambda w: w.fact("ship_date", "month_idx", "revenue").groupBy("ship_date", "month_idx").agg(F.sum("revenue").alias("r")).select("ship_date", dbl(F.sum("r").over(Window.partitionBy("month_idx").orderBy("ship_date").rowsBetween(Window.unboundedPreceding, 0))).alias("mtd"))
)

cte("x_panel", f"SELECT product_id, month_idx, {d('qty')} AS qty, {ratio('profit', 'revenue')} AS margin, {d('qty')} < 0.5*avg({d('qty')}) OVER (PARTITION BY product_id ORDER BY month_idx ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AND count(*) OVER (PARTITION BY product_id ORDER BY month_idx ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) >= 6 AS declining FROM pm")


def panel(w):
    """Product-month panel with a decline flag: quantity under half the mean of up to 12 rows before."""
    f = Window.partitionBy("product_id").orderBy("month_idx").rowsBetween(-12, -1)
    q = dbl("qty")
    return w.product_month().select("product_id", "month_idx", q.alias("qty"), "margin", F.coalesce((q < 0.5 * F.avg(q).over(f)) & (F.count(q).over(f) >= 6), F.lit(False)).alias("declining"))


_F6 = "(PARTITION BY product_id ORDER BY month_idx ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)"


@query("w16_next_rows_label", f"""SELECT product_id, month_idx, qty, margin, coalesce(declining, FALSE) AS declining, CASE WHEN bool_or(declining) OVER {_F6} THEN 1 WHEN max(margin) OVER {_F6} <= 0 AND avg(qty) OVER {_F6} < qty*0.8 THEN 1 ELSE 0 END AS label, count(*) OVER {_F6} AS rows_ahead FROM x_panel""", "qty margin")
def _w16(w):
    return trend.label_next_rows(panel(w))


@query("w17_recovery", f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY month_idx) AS i FROM x_panel), j AS (SELECT t.*, i - e AS k FROM t JOIN (SELECT product_id, min(i) AS e FROM t WHERE declining GROUP BY 1) USING (product_id)),
  b AS (SELECT product_id, quantile_cont(qty, 0.5) FILTER (WHERE k BETWEEN -9 AND -1) AS base, avg(qty) FILTER (WHERE k BETWEEN 1 AND 6) AS a6, avg(qty) FILTER (WHERE k BETWEEN 1 AND 12) AS a12 FROM j GROUP BY 1)
  SELECT product_id, base, a6/base AS ratio_6, a12/base AS ratio_12, first_recovered, CASE WHEN a12/base >= 0.8 THEN 'recovered' WHEN a12/base >= 0.5 THEN 'partial' WHEN a12 IS NULL THEN 'unknown' ELSE 'not_recovered' END AS pattern FROM b LEFT JOIN (SELECT product_id, min(k) AS first_recovered FROM j JOIN b USING (product_id) WHERE k >= 1 AND qty >= base*0.8 GROUP BY 1) USING (product_id) WHERE base > 0""", "base ratio_6 ratio_12")
def _w17(w):
    return trend.recovery(panel(w))


_W6 = "(PARTITION BY product_id ORDER BY month_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
_EW = "list_sum(list_transform(p, lambda z: power(0.5, (x - z.x)/3.0)*{}))"
query("w18_rolling_slopes", f"""SELECT product_id, month_idx, CASE WHEN k >= 3 AND m > 0 THEN s/m END AS slope_ols, CASE WHEN k >= 3 AND m > 0 THEN (sw*sxy - sx*sy)/nullif(sw*sxx - sx*sx, 0)/m END AS slope_weighted, CASE WHEN k >= 3 AND m > 0 THEN sd/m END AS slope_year FROM (
    SELECT *, {_EW.format('1')} AS sw, {_EW.format('z.x')} AS sx, {_EW.format('z.y')} AS sy, {_EW.format('z.x*z.y')} AS sxy, {_EW.format('z.x*z.x')} AS sxx FROM (
      SELECT product_id, month_idx, x, count(*) OVER {_W6} AS k, avg(y) OVER {_W6} AS m, regr_slope(y, x) OVER {_W6} AS s, regr_slope(yd, x) OVER {_W6} AS sd, list({{'x': x, 'y': y}}) OVER {_W6} AS p FROM (
        SELECT t.product_id, t.month_idx, {d('t.qty')} AS y, {d('t.qty')} - {d('b.qty')} AS yd, {d('row_number() OVER (PARTITION BY t.product_id ORDER BY t.month_idx)')} AS x FROM x_panel t LEFT JOIN x_panel b ON b.product_id = t.product_id AND b.month_idx = t.month_idx - 12)))""", "slope_ols slope_weighted slope_year")(lambda w: trend.rolling_slopes(panel(w)))
_B12, _A12 = "(PARTITION BY product_id ORDER BY month_idx ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)", "(PARTITION BY product_id ORDER BY month_idx ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)"
query("w19_severity", f"SELECT product_id, month_idx, CASE WHEN count(*) OVER {_B12} >= 6 AND count(*) OVER {_A12} >= 6 AND avg(qty) OVER {_B12} > 0 THEN 1 - least(avg(qty) OVER {_A12}/avg(qty) OVER {_B12}, 1) END AS severity FROM x_panel", "severity")(lambda w: trend.severity(panel(w)))


@query("w20_product_features", f"""SELECT product_id, month_idx, (m-m0)/nullif(m0,0) AS growth, 1 - m/nullif(peak,0) AS drawdown, margin/nullif(mm,0) AS self_health FROM (SELECT *, lag(m, 12) OVER (PARTITION BY product_id ORDER BY month_idx) AS m0, max(m) OVER (PARTITION BY product_id ORDER BY month_idx ROWS UNBOUNDED PRECEDING) AS peak, avg(margin) OVER (PARTITION BY product_id ORDER BY month_idx ROWS UNBOUNDED PRECEDING) AS mm FROM (
  SELECT *, CASE WHEN count(*) OVER z >= 12 THEN avg(qty) OVER z END AS m FROM x_panel WINDOW z AS (PARTITION BY product_id ORDER BY month_idx ROWS 11 PRECEDING)))""", "growth drawdown self_health")
def _w20(w):
    return trend.product_features(panel(w))


query("w21_two_month_label", f"SELECT product_id, month_idx, CASE WHEN l > 0 THEN CASE WHEN coalesce(n, 0)/61.0 < l/183.0*0.8 THEN 1 ELSE 0 END END AS label FROM (SELECT product_id, month_idx, sum(qty) OVER (PARTITION BY product_id ORDER BY month_idx RANGE BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS n, sum(qty) OVER (PARTITION BY product_id ORDER BY month_idx RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS l FROM x_panel)")(lambda w: trend.two_month_label(panel(w)))


@query("w22_lead_time", """WITH g AS (SELECT product_id, min(i) FILTER (WHERE declining) AS e, min(i) FILTER (WHERE margin < 0) AS low_margin, min(i) FILTER (WHERE qty < 10) AS low_qty FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY month_idx) AS i FROM x_panel) GROUP BY 1)
  SELECT product_id, 'low_margin' AS factor, e - low_margin AS lead_rows FROM g WHERE low_margin <= e UNION ALL SELECT product_id, 'low_qty', e - low_qty FROM g WHERE low_qty <= e""")
def _w22(w):
    return trend.lead_time(panel(w), {"low_margin": F.col("margin") < 0, "low_qty": F.col("qty") < 10})
