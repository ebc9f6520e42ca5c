"""Forecasts."""

from pyspark.sql import functions as F

from ..functions.core import dbl, scalar_int
from ..functions.distribution import quantiles
from ..functions.settle import settle
from ..operators import forecast as ops
from ..operators import smoothing
from .registry import cte, query
from .sqlbits import LM, clip, cnt, d, ratio, tot, win

LINE = ["product_line"]
B = f"CAST(12 - ({LM} - month_idx)//3 AS INT)"
_IN = f"month_idx > {LM} - 36"
cte("q_line", f"SELECT product_line, b AS i, {', '.join(f'coalesce({d(f'sum({m})')}, 0) AS {m}' for m in ('revenue', 'qty', 'cost'))} FROM (SELECT DISTINCT product_line FROM fact) CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INT) AS b) LEFT JOIN (SELECT product_line, {B} AS b, revenue, qty, cost FROM fact WHERE {_IN}) f USING (product_line, b) GROUP BY 1, 2")


def _series(w):
    return ops.quarter_series(w.fact("product_line", "month_idx", "revenue", "qty", "cost", months=36), LINE, w.latest, ("revenue", "qty", "cost"))


@query("f01_quarter_buckets", f"SELECT CAST(b AS INT) AS bucket, CAST({LM} - (12-b)*3 - 2 AS INT) AS from_idx, CAST({LM} - (12-b)*3 AS INT) AS to_idx, b > 12 AS future, coalesce(n, 0) AS months_with_data FROM (SELECT unnest(range(1, 17)) AS b) LEFT JOIN (SELECT {B} AS b, count(DISTINCT month_idx) AS n FROM fact WHERE {_IN} GROUP BY 1) USING (b)")
def _f01(w):
    return ops.bucket_table(w.fact("month_idx", months=36), w.latest)


@query("f02_three_layers", f"""SELECT CASE WHEN gp = 1 THEN 'line' WHEN gc = 1 THEN 'product' ELSE 'product_customer' END AS layer, product_line, product_id, customer_id, bucket, revenue, qty, profit, rows, revenue/nullif(qty,0) AS price FROM (SELECT product_line, product_id, customer_id, bucket, grouping(product_id) AS gp, grouping(customer_id) AS gc, {d('sum(revenue)')} AS revenue, {d('sum(qty)')} AS qty, {d('sum(profit)')} AS profit, count(*) AS rows
  FROM (SELECT *, {B} AS bucket FROM fact WHERE {_IN}) GROUP BY GROUPING SETS ((product_line, bucket), (product_line, product_id, bucket), (product_line, product_id, customer_id, bucket)))""", "revenue qty profit price")
def _f02(w):
    return ops.layers(w.fact("product_line", "product_id", "customer_id", "month_idx", "revenue", "qty", "profit", months=36), w.latest)


query("j10_bucket_lookup", f"SELECT order_id, line_no, product_id, {B} AS bucket FROM fact WHERE {_IN}")(lambda w: w.fact("order_id", "line_no", "product_id", "month_idx", months=36).withColumn("bucket", ops.bucket_of(w.latest)).drop("month_idx"))
query("j09_complete_panel", "SELECT product_line, i AS bucket, revenue FROM q_line", "revenue")(
    lambda w: ops.complete_panel(w.fact("product_line", "month_idx", "revenue", months=36).groupBy("product_line", ops.bucket_of(w.latest).alias("bucket")).agg(dbl(F.sum("revenue")).alias("revenue")), LINE, ["revenue"])
)


def _sql_method(a: str, p: dict, t: str, y: str = "y") -> str:
    """Aggregate over rows (i, y) with i <= t that gives the one-step forecast."""
    k = p.get("k", 4)
    kk = f"least({k}, {t})"
    inw = f"FILTER (WHERE i > {t} - {k})"
    mean = f"avg({y}) {inw}"
    last = f"max({y}) FILTER (WHERE i = {t})"
    first = f"max({y}) FILTER (WHERE i = {t} - {kk} + 1)"
    drift = f"(({last}) - ({first}))/nullif({kk} - 1, 0)"
    return {
        "last": last, "mean": mean, "median": f"quantile_cont({y}, 0.5) {inw}",
        "linear_weighted": f"(sum({y}*(i - ({t} - {kk}))) {inw})/(sum(i - ({t} - {kk})) {inw})",
        "ewma": f"(sum({y}*power({1 - p.get('a', 0)}, {t} - i)) {inw})/(sum(power({1 - p.get('a', 0)}, {t} - i)) {inw})",
        "trend": f"(regr_intercept({y}, i) {inw}) + (regr_slope({y}, i) {inw})*({t} + 1)",
        "log_trend": f"exp((regr_intercept(ln(1+{y}), i) {inw}) + (regr_slope(ln(1+{y}), i) {inw})*({t} + 1)) - 1",
        "drift": f"({last}) + {drift}", "damped": f"({last}) + {drift}",
        "seasonal": f"(max({y}) FILTER (WHERE i = {t} - 3)) * CASE WHEN {t} >= 8 AND (sum({y}) FILTER (WHERE i > {t} - 8 AND i <= {t} - 4)) > 0 THEN least(greatest((sum({y}) FILTER (WHERE i > {t} - 4))/(sum({y}) FILTER (WHERE i > {t} - 8 AND i <= {t} - 4)), 0.5), 1.8) ELSE 1 END",
        "growth": f"({mean})*{1 + p.get('g', 0)}", "decay": f"({mean})*{1 - p.get('g', 0)}",
    }[a]


def _pred(a, p, t):
    return f"least(greatest(coalesce({_sql_method(a, p, t)}, 0), 0), greatest(max(y), avg(y)*2, 1)*3)"


_M = ops.method_specs()
cte("q_all", "SELECT product_line, unnest([" + ", ".join(f"'{n}'" for n, _, _ in _M) + "]) AS method, unnest([" + ", ".join(_pred(a, p, "12") for _, a, p in _M) + "]) AS prediction FROM (SELECT product_line, i, greatest(revenue, 0) AS y FROM q_line) GROUP BY 1")


@query("f03_base_methods", "SELECT * FROM q_all", "prediction")
def _f03(w):
    return ops.all_methods(_series(w).select("product_line", F.col("revenue").alias("v")))


query("f06_method_grid", "SELECT DISTINCT product_line, method FROM q_all")(lambda w: ops.all_methods(_series(w).select("product_line", F.col("revenue").alias("v"))).select("product_line", "method"))
cte("q_bt", "SELECT product_line, measure, t AS fold, unnest([" + ", ".join(f"'{n}'" for n, _, _ in _M) + "]) AS method, unnest([" + ", ".join(_pred(a, p, "any_value(t)") if False else _pred(a, p, "t") for _, a, p in _M) + "]) AS prediction FROM (SELECT product_line, measure, i, greatest(v, 0) AS y, t FROM (UNPIVOT q_line ON revenue, qty, cost INTO NAME measure VALUE v) JOIN (SELECT CAST(unnest(range(6, 12)) AS INT) AS t) ON i <= t) GROUP BY product_line, measure, t")
cte("q_btm", "SELECT b.*, a.v AS actual FROM q_bt b JOIN (SELECT product_line, measure, i, v FROM (UNPIVOT q_line ON revenue, qty, cost INTO NAME measure VALUE v)) a ON a.product_line = b.product_line AND a.measure = b.measure AND a.i = b.fold + 1")
cte(
    "q_rows",
    """SELECT product_line, fold, method, ar AS actual, p_r AS prediction, p_r - ar AS error, abs(p_r-ar) AS abs_error, abs(p_r-ar)/greatest(abs(ar), 1e-9) AS ape, aq AS actual_qty, abs(pq-aq) AS qty_abs_error, ar-ac AS actual_profit, abs((p_r-pc)-(ar-ac)) AS profit_abs_error,
      abs(coalesce((p_r-pc)/nullif(p_r,0),0) - coalesce((ar-ac)/nullif(ar,0),0)) AS margin_abs_error FROM (SELECT product_line, fold, method, max(actual) FILTER (WHERE measure='revenue') AS ar, max(prediction) FILTER (WHERE measure='revenue') AS p_r, max(actual) FILTER (WHERE measure='qty') AS aq, max(prediction) FILTER (WHERE measure='qty') AS pq,
      max(actual) FILTER (WHERE measure='cost') AS ac, max(prediction) FILTER (WHERE measure='cost') AS pc FROM q_btm GROUP BY 1, 2, 3)""",
)
cte(
    "q_rank",
    """SELECT *, row_number() OVER (PARTITION BY product_line ORDER BY round(score, 10), round(wape, 10), method) AS rank FROM (SELECT *, wape*0.5 + mape*0.15 + abs(bias)*0.1 + qty_wape*0.1 + profit_wape*0.1 + margin_mae*0.05 AS score FROM (
      SELECT product_line, method, sum(abs_error)/greatest(sum(abs(actual)), 1e-9) AS wape, least(avg(ape), 5) AS mape, sum(error)/greatest(sum(actual), 1e-9) AS bias, sum(qty_abs_error)/greatest(sum(abs(actual_qty)), 1e-9) AS qty_wape, sum(profit_abs_error)/greatest(sum(abs(actual_profit)), 1e-9) AS profit_wape,
        least(avg(margin_abs_error), 1) AS margin_mae, stddev_samp(ape) AS stability FROM q_rows GROUP BY 1, 2))""",
)


def _rank(w):
    s = settle(_series(w))
    return s, settle(ops.rank_methods(ops.metric_rows(ops.backtest(s, LINE), LINE), LINE))


_RR = "actual prediction error abs_error ape actual_qty qty_abs_error actual_profit profit_abs_error margin_abs_error"
query("f34_error_metrics", "SELECT * FROM q_rows", _RR)(lambda w: ops.metric_rows(ops.backtest(settle(_series(w)), LINE), LINE))
query("f08_backtest_ranking", "SELECT * FROM q_rank", "wape mape bias qty_wape profit_wape margin_mae stability score")(lambda w: _rank(w)[1])
query("f09_final_forecast")(lambda w: (lambda s, r: ops.final_forecast(s, r, LINE))(*_rank(w)))
query("f10_locked_ranking", "SELECT l.product_line, coalesce(method, 'mean_4') AS method, method IS NULL AS is_new_series FROM (SELECT DISTINCT product_line FROM fact) l LEFT JOIN (SELECT product_line, method FROM q_rank WHERE rank = 1 AND product_line <> 'Brand#1') USING (product_line)")(
    lambda w: (lambda s, r: ops.locked_ranking(s, r.filter((F.col("rank") == 1) & (F.col("product_line") != "Brand#1")), LINE))(*_rank(w))
)
query("f14_fast_backtest", "SELECT *, row_number() OVER (PARTITION BY product_line ORDER BY round(wape, 10), method) AS rank FROM (SELECT product_line, method, sum(abs(prediction-actual))/greatest(sum(abs(actual)), 1e-9) AS wape FROM q_btm WHERE measure = 'revenue' GROUP BY 1, 2)", "wape")(
    lambda w: ops.fast_backtest(_series(w).select("product_line", F.col("revenue").alias("v")), LINE)
)
query("f46_ensembles", """WITH r AS (SELECT * FROM q_btm WHERE measure = 'revenue'), v AS (SELECT * FROM (SELECT product_line, method, w, row_number() OVER (PARTITION BY product_line ORDER BY round(w, 10), method) AS rank FROM (SELECT product_line, method, sum(abs(prediction-actual))/greatest(sum(abs(actual)), 1e-9) AS w FROM r WHERE fold IN (6,7,8) GROUP BY 1, 2)) WHERE rank <= 8),
  g AS (SELECT product_line, fold, max(actual) AS actual, avg(prediction) AS mean, sum(prediction/greatest(w, 1e-6))/sum(1/greatest(w, 1e-6)) AS inverse_error, sum(prediction/rank)/sum(1.0/rank) AS inverse_rank FROM r JOIN v USING (product_line, method) WHERE fold NOT IN (6,7,8) GROUP BY 1, 2)
  SELECT product_line, ensemble, sum(abs(p-actual))/greatest(sum(abs(actual)), 1e-9) AS wape FROM (UNPIVOT g ON mean, inverse_error, inverse_rank INTO NAME ensemble VALUE p) GROUP BY 1, 2""", "wape")(lambda w: ops.ensembles(settle(ops.backtest(settle(_series(w)), LINE)), LINE))


# --- monthly ---
def _first(w):
    return scalar_int(w.fact("month_idx"), F.min("month_idx"))


def _months(w):
    return ops.monthly_series(w.fact("product_line", "month_idx", "revenue"), LINE, _first(w), w.latest)


cte("m_line", f"SELECT product_line, m AS month_idx, coalesce({d('sum(revenue)')}, 0) AS v, row_number() OVER (PARTITION BY product_line ORDER BY m) AS i FROM (SELECT DISTINCT product_line FROM fact) CROSS JOIN (SELECT CAST(unnest(range((SELECT min(month_idx) FROM fact), {LM} + 1)) AS INT) AS m) LEFT JOIN (SELECT product_line, month_idx AS m, revenue FROM fact) f USING (product_line, m) GROUP BY 1, 2")
_H = "(PARTITION BY product_line ORDER BY i ROWS BETWEEN {} PRECEDING AND {} PRECEDING)"


def _tr(k):
    w = _H.format(k, 1)
    return f"CASE WHEN max(v) OVER {w} > min(v) OVER {w} THEN greatest(regr_intercept(v, i) OVER {w} + regr_slope(v, i) OVER {w}*i, 0) ELSE avg(v) OVER {w} END"


_MS = {
    "naive": "lag(v) OVER (PARTITION BY product_line ORDER BY i)", "ma3": f"avg(v) OVER {_H.format(3, 1)}", "ma6": f"avg(v) OVER {_H.format(6, 1)}", "ma12": f"avg(v) OVER {_H.format(12, 1)}", "snaive": "lag(v, 12) OVER (PARTITION BY product_line ORDER BY i)",
    "yoy_adj": f"lag(v, 12) OVER (PARTITION BY product_line ORDER BY i) * CASE WHEN i > 24 AND sum(v) OVER {_H.format(24, 13)} > 100000 THEN sum(v) OVER {_H.format(12, 1)}/sum(v) OVER {_H.format(24, 13)} ELSE 1 END", "trend6": _tr(6), "trend12": _tr(12),
}
cte("m_bt", "SELECT *, row_number() OVER (PARTITION BY product_line ORDER BY round(wape, 10) NULLS LAST, o) AS rank FROM (SELECT product_line, method, o, CASE WHEN sum(v) > 0 THEN sum(abs(p-v))/sum(v) END AS wape FROM (" + " UNION ALL ".join(f"SELECT product_line, i, v, {x} AS p, '{m}' AS method, {o} AS o FROM m_line" for o, (m, x) in enumerate(_MS.items())) + ") WHERE i > (SELECT max(i) FROM m_line) - 20 AND i >= 13 GROUP BY 1, 2, 3)")
query("f21_method_selection", "SELECT product_line, method, wape, rank FROM m_bt", "wape")(lambda w: ops.monthly_backtest(_months(w), LINE))


# The next month of a list of months `h` by the method of the row.
def _trend_next(k):
    t = f"h[-least({k}, len(h)):]"
    n = f"CAST(len({t}) AS DOUBLE)"
    sx, sxx = f"({n}*({n}-1)/2)", f"(({n}-1)*{n}*(2*{n}-1)/6)"
    slope = f"(({n}*list_sum(list_transform({t}, lambda x, i: x*(i-1))) - {sx}*list_sum({t}))/({n}*{sxx} - {sx}*{sx}))"
    return f"CASE WHEN len({t}) >= 3 AND list_max({t}) > list_min({t}) THEN greatest((list_sum({t}) - {slope}*{sx})/{n} + {slope}*{n}, 0) ELSE list_avg({t}) END"


_YEAR_AGO = "CASE WHEN len(h) >= 12 THEN h[-12] ELSE list_avg(h) END"
_NEXT = f"""CASE method WHEN 'naive' THEN h[-1] {' '.join(f"WHEN 'ma{k}' THEN list_avg(h[-least({k}, len(h)):])" for k in (3, 6, 12))} WHEN 'snaive' THEN {_YEAR_AGO}
  WHEN 'yoy_adj' THEN {_YEAR_AGO} * CASE WHEN len(h) >= 24 AND list_sum(h[-24:-13]) > 100000 THEN list_sum(h[-12:])/list_sum(h[-24:-13]) ELSE 1 END {' '.join(f"WHEN 'trend{k}' THEN {_trend_next(k)}" for k in (6, 12))} END"""
cte("m_hist", "SELECT product_line, method, wape, h FROM (SELECT product_line, list(v ORDER BY i) AS h FROM m_line GROUP BY 1) JOIN m_bt USING (product_line) WHERE rank = 1")
query("f20_monthly_methods", f"SELECT product_line, method, wape, {_NEXT} AS forecast FROM m_hist", "wape forecast")(lambda w: ops.next_month(_months(w), ops.monthly_backtest(_months(w), LINE), LINE))


def _category_months(w):
    return ops.monthly_series(w.fact("category", "month_idx", "revenue"), ["category"], _first(w), w.latest)


def _revenue(w, key, months):
    return w.fact(key, "month_idx", "revenue", months=months).groupBy(key).agg(dbl(F.sum("revenue")).alias("revenue"))


cte("m_conf", f"SELECT product_line, method, wape, revenue, revenue/sum(revenue) OVER () AS share, CASE WHEN wape <= 0.15 THEN 'A' WHEN wape <= 0.25 THEN 'B' ELSE 'C' END AS tier FROM m_bt JOIN (SELECT product_line, {d('sum(revenue)')} AS revenue FROM fact WHERE {win(20)} GROUP BY 1) USING (product_line) WHERE rank = 1")
query("f24_line_confidence", "SELECT * FROM m_conf", "wape revenue share")(lambda w: ops.line_confidence(ops.monthly_backtest(_months(w), LINE), _revenue(w, "product_line", 20), LINE))
query("f24_confidence_tiers", "SELECT tier, count(*) AS series, sum(revenue) AS revenue, sum(share) AS share FROM m_conf GROUP BY 1", "revenue share")(lambda w: ops.confidence_tiers(ops.monthly_backtest(_months(w), LINE), _revenue(w, "product_line", 20), LINE))


def _company(w):
    return w.fact("month_idx", "revenue").groupBy("month_idx").agg(dbl(F.sum("revenue")).alias("revenue"))


def _festival(w):
    """Festival in February of every year around the data (a parameter of the rule)."""
    return {y: y * 12 + 2 for y in range((w.latest - 1) // 12 - 8, (w.latest - 1) // 12 + 3)}


cte("co_month", f"SELECT month_idx, {d('sum(revenue)')} AS v FROM fact GROUP BY 1")
cte("co_past", "SELECT list(v ORDER BY month_idx) AS past, max(month_idx) AS m1 FROM co_month")
_MEAN6 = "list_avg(h[-least(6, len(h)):])"
cte("co_ahead", f"""WITH RECURSIVE r AS (
    SELECT 0 AS step, past AS h, CAST(NULL AS INT) AS month_idx, CAST(NULL AS DOUBLE) AS forecast, '' AS rule FROM co_past
    UNION ALL
    SELECT step, list_append(h, f) AS h, m AS month_idx, f AS forecast, rule FROM (
      SELECT step, h, m, rule, CASE rule WHEN 'festival' THEN h[-1]*0.53 WHEN 'ma6' THEN {_MEAN6} ELSE list_aggregate([{_MEAN6}*1.17, ago*list_sum(h[-12:])/greatest(list_sum(h[-24:-13]), 1), CASE WHEN earlier > 0 THEN earlier*power(ago/earlier, 1.5) END], 'median') END AS f
      FROM (SELECT step + 1 AS step, h, CAST(m1 + step + 1 AS INT) AS m, CASE (m1 + step + 1) % 12 WHEN 2 THEN 'festival' WHEN 1 THEN 'pre_festival' ELSE 'ma6' END AS rule, past[len(past) - 11 + step] AS ago, past[len(past) - 35 + step] AS earlier FROM r, co_past WHERE step < 12)))
  SELECT step, month_idx, forecast, rule FROM r WHERE step > 0""")
query("f22_company_forecast", "SELECT month_idx, forecast, rule FROM co_ahead", "forecast")(lambda w: ops.company_forecast(_company(w), _festival(w)))


def _anchor(w):
    return ops.company_forecast(_company(w), _festival(w)).select((F.col("month_idx") - w.latest).alias("step"), F.col("forecast").alias("anchor"))


def _ahead(key, hist):
    """Twelve months of each series by its method, every month appended to its list, then scaled to the company."""
    return f"""SELECT {key}, method, wape, step, forecast, forecast*CASE WHEN sum(forecast) OVER (PARTITION BY step) > 0 THEN anchor/sum(forecast) OVER (PARTITION BY step) ELSE 1 END AS reconciled, anchor FROM (
    WITH RECURSIVE r AS (SELECT {key}, method, wape, 0 AS step, h, CAST(NULL AS DOUBLE) AS forecast FROM {hist} UNION ALL SELECT {key}, method, wape, step + 1 AS step, list_append(h, {_NEXT}) AS h, {_NEXT} AS forecast FROM r WHERE step < 12)
    SELECT {key}, method, wape, step, forecast FROM r WHERE step > 0) JOIN (SELECT step, forecast AS anchor FROM co_ahead) USING (step)"""


query("f23_reconciled_detail", _ahead("product_line", "m_hist"), "wape forecast reconciled anchor")(lambda w: ops.detail_forecast(_months(w), LINE, _anchor(w)))
cte("mc_line", f"SELECT category AS product_line, m AS month_idx, coalesce({d('sum(revenue)')}, 0) AS v, row_number() OVER (PARTITION BY category ORDER BY m) AS i FROM (SELECT DISTINCT category FROM fact) CROSS JOIN (SELECT CAST(unnest(range((SELECT min(month_idx) FROM fact), {LM} + 1)) AS INT) AS m) LEFT JOIN (SELECT category, month_idx AS m, revenue FROM fact) f USING (category, m) GROUP BY 1, 2")
cte("mc_bt", "SELECT *, row_number() OVER (PARTITION BY product_line ORDER BY round(wape, 10) NULLS LAST, o) AS rank FROM (SELECT product_line, method, o, CASE WHEN sum(v) > 0 THEN sum(abs(p-v))/sum(v) END AS wape FROM (" + " UNION ALL ".join(f"SELECT product_line, i, v, {x} AS p, '{m}' AS method, {o} AS o FROM mc_line" for o, (m, x) in enumerate(_MS.items())) + ") WHERE i > (SELECT max(i) FROM mc_line) - 20 AND i >= 13 GROUP BY 1, 2, 3)")
cte("mc_hist", "SELECT product_line AS category, method, wape, h FROM (SELECT product_line, list(v ORDER BY i) AS h FROM mc_line GROUP BY 1) JOIN mc_bt USING (product_line) WHERE rank = 1")


@query("f23_category_detail", f"""SELECT coalesce(kept, 'other') AS category, step, sum(forecast) AS forecast, sum(reconciled) AS reconciled, count(*) AS series FROM ({_ahead('category', 'mc_hist')}) LEFT JOIN (SELECT category AS kept FROM fact WHERE {win(12)} GROUP BY 1 ORDER BY sum(revenue) DESC, 1 LIMIT 3) ON kept = category GROUP BY 1, 2""", "forecast reconciled")
def _f23c(w):
    return ops.largest_and_rest(ops.detail_forecast(_category_months(w), ["category"], _anchor(w)), _revenue(w, "category", 12), "category", 3)


cte("co_ratio", "SELECT v/p AS ratio FROM (SELECT month_idx, v, avg(v) OVER (ORDER BY month_idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS p FROM co_month) WHERE month_idx > (SELECT m1 FROM co_past) - 20 AND p > 0")


def _past_ratios(w):
    """Actual over the mean of the six months before, for the last 20 months."""
    m = _company(w)
    before = m.select(F.explode(F.sequence(F.col("month_idx") + 1, F.col("month_idx") + 6)).alias("month_idx"), "revenue").groupBy("month_idx").agg(F.avg("revenue").alias("p"))
    return m.join(before, "month_idx").filter((F.col("month_idx") > w.latest - 20) & (F.col("p") > 0)).select((F.col("revenue") / F.col("p")).alias("ratio"))


query("f25_bootstrap_interval", """SELECT quantile_cont(s, 0.1) AS p10, quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.9) AS p90 FROM (
    SELECT id, sum(forecast*a[CAST(floor(CAST('0x' || substr(md5('42:' || id || ':' || step), 1, 8) AS BIGINT)*len(a)/4294967296.0) AS INT) + 1]) AS s FROM (SELECT unnest(range(4000)) AS id), co_ahead, (SELECT list(ratio ORDER BY ratio) AS a FROM co_ratio) GROUP BY 1)""", "p10 p50 p90")(
    lambda w: ops.bootstrap_interval(_past_ratios(w), _anchor(w).withColumnRenamed("anchor", "forecast"))
)

@query("s08_long_history", f"SELECT product_line, month_idx, {d('sum(revenue)')} AS revenue FROM fact GROUP BY 1, 2", "revenue")
def _s08(w):
    from ..sources import io

    monthly = w.fact("product_line", "month_idx", "revenue").groupBy("product_line", "month_idx").agg(dbl(F.sum("revenue")).alias("revenue"))
    old = F.col("month_idx") <= w.latest - 24
    return io.long_history(monthly.filter(old), monthly.filter(~old), ["product_line", "month_idx"])


# --- intermittent, smoothing ---
def _prod_quarters(w):
    return ops.quarter_series(w.fact("product_id", "month_idx", "qty", months=36), ["product_id"], w.latest, ("qty",)).withColumnRenamed("qty", "v")


cte("x_pq", f"SELECT product_id, list(greatest(coalesce(q, 0), 0) ORDER BY i) AS v FROM (SELECT DISTINCT product_id FROM fact WHERE {_IN}) CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INT) AS i) LEFT JOIN (SELECT product_id, {B} AS i, {d('sum(qty)')} AS q FROM fact WHERE {_IN} GROUP BY 1, 2) USING (product_id, i) GROUP BY 1")


def _croston(v, a):
    """A fold over a list: smoothed size and interval of the values above 0."""
    hit = f"CASE WHEN y > 0 THEN {{'z': CASE WHEN s.z IS NULL THEN y ELSE {a}*y + (1-{a})*s.z END, 'x': CASE WHEN s.z IS NULL THEN 1.0 ELSE {a}*(s.gap+1) + (1-{a})*s.x END, 'gap': 0.0}} ELSE {{'z': s.z, 'x': s.x, 'gap': s.gap + 1}} END"
    s = f"list_reduce({v}, lambda s, y: {hit}, {{'z': CAST(NULL AS DOUBLE), 'x': CAST(NULL AS DOUBLE), 'gap': CAST(0 AS DOUBLE)}})"
    return f"coalesce({s}.z/greatest({s}.x, 1), 0)"


def _tsb(v, a, b):
    hit = f"{{'p': CASE WHEN s.p IS NULL THEN CAST(y > 0 AS DOUBLE) ELSE s.p + {b}*(CAST(y > 0 AS DOUBLE) - s.p) END, 'z': CASE WHEN y > 0 THEN CASE WHEN s.z IS NULL THEN y ELSE s.z + {a}*(y - s.z) END ELSE s.z END}}"
    s = f"list_reduce({v}, lambda s, y: {hit}, {{'p': CAST(NULL AS DOUBLE), 'z': CAST(NULL AS DOUBLE)}})"
    return f"coalesce({s}.z*{s}.p, 0)"


def _adida(v, k):
    sums = f"list_transform(range(len({v})//{k}), lambda b: list_sum({v}[len({v}) - (len({v})//{k} - b)*{k} + 1 : len({v}) - (len({v})//{k} - b - 1)*{k}]))"
    return f"coalesce(list_reduce({sums}, lambda s, y: 0.3*y + 0.7*s)/{k}, 0)"


query("f04_croston", f"SELECT product_id, {_croston('v', 0.1)} AS forecast FROM x_pq", "forecast")(lambda w: _prod_quarters(w).select("product_id", ops.croston(F.transform("v", lambda x: F.greatest(x, F.lit(0.0))), 0.1).alias("forecast")))
query("f39_intermittent_methods", f"""SELECT product_id, coalesce(list_avg(list_filter(v, lambda x: x > 0))*len(list_filter(v, lambda x: x > 0))/len(v), 0) AS zero_inflated, {_croston('v', 0.1)} AS croston, {_croston('v', 0.1)}*0.95 AS sba, {_tsb('v', 0.1, 0.1)} AS tsb, {_adida('v', 3)} AS adida, ({' + '.join(_adida('v', k) for k in (1, 2, 3))})/3 AS imapa FROM x_pq""", "zero_inflated croston sba tsb adida imapa")(
    lambda w: _prod_quarters(w).select("product_id", F.transform("v", lambda x: F.greatest(x, F.lit(0.0))).alias("v")).select("product_id", *[fn(F.col("v")).alias(n) for n, fn in ops.INTERMITTENT.items()])
)
query("f38_intermittency", f"""SELECT *, active_share < 0.5 AS intermittent, active_quarters <= 1 OR coalesce(cv > 1.5, FALSE) AS unforecastable FROM (SELECT product_id, {cnt('q > 0')}/36.0 AS active_share FROM (SELECT product_id, month_idx, sum(qty) AS q FROM fact WHERE {win(36)} GROUP BY 1, 2) GROUP BY 1) JOIN (
  SELECT product_id, count(*) FILTER (WHERE qr < 4 AND q > 0) AS active_quarters, stddev_samp(CASE WHEN q > 0 THEN q END)/avg(CASE WHEN q > 0 THEN q END) AS cv FROM (SELECT product_id, ({LM} - month_idx)//3 AS qr, {d('sum(qty)')} AS q FROM fact WHERE {win(36)} GROUP BY 1, 2) GROUP BY 1) USING (product_id)""", "active_share cv")(
    lambda w: ops.intermittency(w.fact("product_id", "month_idx", "qty", months=36), "product_id", w.latest)
)
query("f16_ets")(lambda w: smoothing.ets(_months(w), LINE, h=3, period=12))


@query("f19_customer_forecast")
def _f19(w):
    bought = w.fact("customer_id", "month_idx", "revenue").groupBy("customer_id", "month_idx").agg(dbl(F.sum("revenue")).alias("revenue"))
    return ops.customer_forecast(bought, w.latest)


query("f17_weighted_ma", f"SELECT customer_id, greatest((y1 + 2*y2 + 3*y3)/6 + (y3-y1)/2*0.5, 0) AS forecast FROM (SELECT customer_id, {', '.join(f'{tot('revenue', f'month_idx = {LM} - {3 - i}')} AS y{i}' for i in (1, 2, 3))} FROM fact WHERE {win(36)} GROUP BY 1)", "forecast")(
    lambda w: ops.monthly_series(w.fact("customer_id", "month_idx", "revenue", months=36), ["customer_id"], w.latest - 35, w.latest).select("customer_id", ops.weighted_ma(F.col("v")).alias("forecast"))
)


def _ratios(w):
    m = w.fact("month", "month_idx").distinct()
    nxt = m.filter(F.col("month_idx") == w.latest).select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"), "month", "month_idx").select(F.add_months("month", F.col("k")).alias("month"), (F.col("month_idx") + F.col("k")).cast("int").alias("month_idx"))
    return ops.workday_ratios(m.unionByName(nxt))


_WD = f"SELECT month_idx, count(*) FILTER (WHERE isodow(CAST(dd AS DATE)) <= 5)/22.0 AS ratio FROM (SELECT month_idx, unnest(generate_series(month, month + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS dd FROM (SELECT DISTINCT month_idx, month FROM fact UNION ALL SELECT m + k, CAST(mm + to_months(CAST(k AS INT)) AS DATE) FROM (SELECT max(month_idx) AS m, max(month) AS mm FROM fact), (SELECT CAST(unnest(range(1, 4)) AS INT) AS k))) GROUP BY 1"
cte("x_wd", _WD)
query("f31_workday_ratios", "SELECT * FROM x_wd", "ratio")(_ratios)
query("f18_holiday_adjustment", f"SELECT month_idx, ratio, {clip('ratio/h', 0.5, 1.2)} AS adjustment FROM x_wd JOIN (SELECT (month_idx-1)%12 AS mm, avg(ratio) AS h FROM x_wd WHERE month_idx <= {LM} GROUP BY 1) ON (month_idx-1)%12 = mm WHERE month_idx > {LM}", "ratio adjustment")(lambda w: ops.holiday_adjustment(_ratios(w), w.latest))


# --- prices, shares, reconciliation, layering ---
def _layer(w, *keys):
    f = w.fact(*keys, "month_idx", "revenue", "qty", "cost", months=36)
    return f.groupBy(*keys, ops.bucket_of(w.latest).alias("bucket")).agg(*[dbl(F.sum(m)).alias(m) for m in ("revenue", "qty", "cost")])


cte("q_prod", f"SELECT product_line, product_id, {B} AS bucket, {d('sum(revenue)')} AS revenue, {d('sum(qty)')} AS qty, {d('sum(cost)')} AS cost FROM fact WHERE {_IN} GROUP BY 1, 2, 3")


def _px(c, m="revenue"):
    return f"CASE WHEN {tot('qty', c)} > 0 THEN {tot(m, c)}/{tot('qty', c)} END"


query("f07_recent_prices", f"""SELECT product_line, product_id, coalesce(own, lp, cp) AS price, tf AS trend_factor, coalesce(own, lp, cp)*tf AS forecast_price, CASE WHEN own IS NOT NULL THEN 'own' WHEN lp IS NOT NULL THEN 'line' ELSE 'company' END AS price_source FROM (SELECT *, coalesce(least(greatest(sqrt(p2/nullif(p4,0)), 0.8), 1.15), 1) AS tf FROM (
  SELECT product_line, product_id, coalesce({', '.join(_px(f'bucket > {12 - n}') for n in (1, 2, 4, 12))}) AS own, {_px('bucket > 10')} AS p2, {_px('bucket <= 10 AND bucket > 8')} AS p4 FROM q_prod GROUP BY 1, 2)) JOIN (SELECT product_line, {_px('bucket > 8')} AS lp FROM q_prod GROUP BY 1) USING (product_line), (SELECT {_px('bucket > 0')} AS cp FROM q_prod)""", "price trend_factor forecast_price")(lambda w: ops.recent_prices(_layer(w, "product_line", "product_id")))
query("f11_contribution", f"SELECT product_line, product_id, {d('sum(revenue)')} AS revenue, sum(revenue)/sum(sum(revenue)) OVER (PARTITION BY product_line) AS share, sum(revenue)/nullif(sum(qty),0) AS price FROM q_prod WHERE bucket > 8 GROUP BY 1, 2", "revenue share price")(
    lambda w: (lambda g: g.join(g.groupBy("product_line").agg(F.sum("revenue").alias("t")), "product_line").select("product_line", "product_id", "revenue", (F.col("revenue") / F.col("t")).alias("share"), (F.col("revenue") / F.nullif(F.col("qty"), F.lit(0.0))).alias("price")))(
        _layer(w, "product_line", "product_id").filter(F.col("bucket") > 8).groupBy("product_line", "product_id").agg(F.sum("revenue").alias("revenue"), F.sum("qty").alias("qty")))
)
query("f12_entity_asp", f"SELECT product_line, asp, unit_cost, tr AS trend, asp*(1+tr) AS forecast_asp FROM (SELECT *, coalesce(least(greatest((asp/nullif(ab,0) - 1)*0.5, -0.1), 0.1), 0) AS tr FROM (SELECT product_line, {_px('bucket > 9')} AS asp, {_px('bucket <= 9 AND bucket > 6')} AS ab, {_px('bucket > 9', 'cost')} AS unit_cost FROM q_prod GROUP BY 1))", "asp unit_cost trend forecast_asp")(lambda w: ops.entity_asp(_layer(w, "product_line"), LINE))
query("f13_shrunk_shares", """WITH g AS (SELECT product_line, product_id, coalesce(sum(revenue) FILTER (WHERE bucket > 8), 0) AS v, count(DISTINCT bucket) AS n FROM q_prod GROUP BY 1, 2), s AS (SELECT *, (n*coalesce(v/nullif(sum(v) OVER (PARTITION BY product_line), 0), 0) + 4.0/count(*) OVER (PARTITION BY product_line))/(n+4) AS s, v/nullif(sum(v) OVER (PARTITION BY product_line), 0) AS raw_share FROM g)
  SELECT product_line, product_id, n, raw_share, s/sum(s) OVER (PARTITION BY product_line) AS share FROM s""", "raw_share share")(lambda w: ops.shrunk_shares(_layer(w, "product_line", "product_id"), LINE, ["product_id"]))
query("f33_mix_price", "SELECT product_line, sum(q*(r/q))/sum(q) AS mix_price, count(*) AS products FROM (SELECT product_line, product_id, sum(qty) AS q, sum(revenue) AS r FROM q_prod WHERE bucket > 8 GROUP BY 1, 2) WHERE q > 0 GROUP BY 1", "mix_price")(lambda w: ops.product_mix_price(_layer(w, "product_line", "product_id")))
query("f35_customer_price", f"SELECT customer_id, product_id, {_px('TRUE')} AS price FROM (SELECT customer_id, product_id, {B} AS bucket, {d('sum(revenue)')} AS revenue, {d('sum(qty)')} AS qty FROM fact WHERE {_IN} GROUP BY 1, 2, 3) WHERE bucket > 9 GROUP BY 1, 2", "price")(
    lambda w: _layer(w, "customer_id", "product_id").filter(F.col("bucket") > 9).groupBy("customer_id", "product_id").agg(F.when(F.sum("qty") > 0, F.sum("revenue") / F.nullif(F.sum("qty"), F.lit(0.0))).alias("price"))
)


def _reconciled(w):
    s = ops.quarter_series(w.fact("product_line", "category", "product_id", "month_idx", "revenue", months=36), ["product_line", "category", "product_id"], w.latest, ("revenue",))
    train = F.slice("revenue", 1, 11)
    var = ops.amean(F.transform(train, lambda x: (x - ops.amean(train)) * (x - ops.amean(train))))
    leaf = s.select("product_line", "category", "product_id", ops.amean(ops.tail(train, 4)).alias("forecast"), var.alias("variance")).withColumn("category_forecast_share", F.col("forecast"))
    line = ops.quarter_series(w.fact("product_line", "month_idx", "revenue", months=36), LINE, w.latest, ("revenue",))
    top = line.select("product_line", ops.amean(ops.tail(train, 6)).alias("forecast"), var.alias("variance"))
    hist = line.select("product_line", ops.asum(train).alias("revenue"))
    return ops.reconcile(leaf, hist, top), line.select("product_line", F.element_at("revenue", 12).alias("actual"))


_RV = "avg(y*y) FILTER (WHERE i <= 11) - power(avg(y) FILTER (WHERE i <= 11), 2)"
cte("q_rec", f"""SELECT product_line, bottom_up, h/sum(h) OVER ()*sum(own) OVER () AS top_down, bottom_up AS middle_out, own, own*(lv/nullif(lv+ov,0)) + bottom_up*(1 - lv/nullif(lv+ov,0)) AS least_squares, actual FROM (SELECT product_line, sum(f) AS bottom_up, sum(v) AS lv FROM (SELECT product_line, product_id, avg(y) FILTER (WHERE i BETWEEN 8 AND 11) AS f, {_RV} AS v FROM (
    SELECT product_line, product_id, i, coalesce(revenue, 0) AS y FROM (SELECT DISTINCT product_line, product_id FROM q_prod) CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INT) AS i) LEFT JOIN (SELECT product_line, product_id, bucket AS i, revenue FROM q_prod) USING (product_line, product_id, i)) GROUP BY 1, 2) GROUP BY 1)
  JOIN (SELECT product_line, avg(y) FILTER (WHERE i BETWEEN 6 AND 11) AS own, {_RV} AS ov, sum(y) FILTER (WHERE i <= 11) AS h, max(y) FILTER (WHERE i = 12) AS actual FROM (SELECT product_line, i, revenue AS y FROM q_line) GROUP BY 1) USING (product_line)""")
query("f43_best_reconciliation", "SELECT *, row_number() OVER (ORDER BY round(mean_ape, 10), method) AS rank FROM (SELECT method, avg(abs(f - actual)/greatest(abs(actual), 1e-9)) AS mean_ape FROM (UNPIVOT (SELECT product_line, bottom_up, top_down, middle_out, least_squares, actual FROM q_rec) ON bottom_up, top_down, middle_out, least_squares INTO NAME method VALUE f) GROUP BY 1)", "mean_ape")(lambda w: ops.best_reconciliation(*_reconciled(w)))
query("f42_reconciliation", "SELECT product_line, bottom_up, top_down, middle_out, own, least_squares FROM q_rec", "bottom_up top_down middle_out own least_squares")(lambda w: _reconciled(w)[0])


_TREE = [["product_line", "category", "product_id"], ["product_line", "category"], ["product_line"], []]


def _level(w, keys):
    """Mean of the last four training quarters of leaves, the last six of other nodes, and the variance of all eleven."""
    s = ops.quarter_series(w.fact(*keys, "month_idx", "revenue", months=36), keys, w.latest, ("revenue",))
    train = F.slice("revenue", 1, 11)
    return s.select(*keys, ops.amean(ops.tail(train, 4 if "product_id" in keys else 6)).alias("forecast"), ops.amean(F.transform(train, lambda x: (x - ops.amean(train)) * (x - ops.amean(train)))).alias("variance"))


def _node(keys):
    k = "".join(f"{x}, " for x in keys)
    return f"SELECT {k}avg(y) FILTER (WHERE i BETWEEN {8 if 'product_id' in keys else 6} AND 11) AS own, greatest(avg(y*y) FILTER (WHERE i <= 11) - power(avg(y) FILTER (WHERE i <= 11), 2), 1e-9) AS v FROM (SELECT {k}i, coalesce(y, 0) AS y FROM (SELECT DISTINCT {k}0 AS z FROM fact WHERE {_IN}) CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INT) AS i) LEFT JOIN (SELECT {k}{B} AS i, {d('sum(revenue)')} AS y FROM fact WHERE {_IN} GROUP BY ALL) USING ({k}i)) GROUP BY ALL"


_UP = "SELECT {k}own, b, vb, (b/vb + own/v)/(1/vb + 1/v) AS z, 1/(1/vb + 1/v) AS s FROM (SELECT {k}sum(z) AS b, sum(s) AS vb FROM {c} GROUP BY ALL) {j} ({n}) t{u}"
for _i, _keys in enumerate(_TREE):
    _k = "".join(f"{x}, " for x in _keys)
    cte(f"tree_up{_i}", f"SELECT *, own AS z, v AS s FROM ({_node(_keys)})" if _i == 0 else _UP.format(k=_k, c=f"tree_up{_i - 1}", j="JOIN" if _keys else "CROSS JOIN", n=_node(_keys), u=f" USING ({', '.join(_keys)})" if _keys else ""))
for _i, _keys in reversed(list(enumerate(_TREE))):
    _p = _TREE[_i + 1] if _keys else []
    cte(f"tree_final{_i}", f"SELECT *, z AS reconciled FROM tree_up{_i}" if not _keys else f"SELECT c.*, c.z + (p.reconciled - p.b)*c.s/p.vb AS reconciled FROM tree_up{_i} c JOIN tree_final{_i + 1} p ON TRUE{''.join(f' AND c.{x} = p.{x}' for x in _p)}")
query("f42_least_squares", " UNION ALL ".join(f"SELECT {i} AS level, {', '.join(x if x in keys else f'NULL AS {x}' for x in _TREE[0])}, own AS forecast, reconciled FROM tree_final{i}" for i, keys in enumerate(_TREE)), "forecast reconciled")(lambda w: ops.least_squares_tree([(keys, _level(w, keys)) for keys in _TREE]))


def _cust_q(w):
    s = ops.quarter_series(w.fact("customer_id", "tier", "month_idx", "revenue", months=36), ["customer_id", "tier"], w.latest, ("revenue",))
    return s.withColumnRenamed("revenue", "v")


cte("x_cq", f"SELECT customer_id, tier, list(coalesce(q, 0) ORDER BY i) AS v FROM (SELECT DISTINCT customer_id, tier FROM fact WHERE {_IN}) CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INT) AS i) LEFT JOIN (SELECT customer_id, {B} AS i, {d('sum(revenue)')} AS q FROM fact WHERE {_IN} GROUP BY 1, 2) USING (customer_id, i) GROUP BY 1, 2")
cte("x_seg", "SELECT *, CASE WHEN last4 = 0 THEN 'dormant' WHEN active_quarters = 1 THEN 'one_off' WHEN active_quarters >= 6 THEN 'active' ELSE 'sparse' END AS segment FROM (SELECT *, CAST(len(list_filter(v, lambda x: x > 0)) AS INT) AS active_quarters, len(list_filter(v[-4:], lambda x: x > 0)) AS last4 FROM x_cq)")
query("f27_longtail_forecast", f"""SELECT customer_id, tier, active_quarters, segment, CASE segment WHEN 'active' THEN list_avg(v[-4:]) WHEN 'sparse' THEN {_croston('v', 0.2)} WHEN 'one_off' THEN coalesce(m, 0)/12 ELSE 0 END AS forecast FROM x_seg LEFT JOIN (SELECT tier, quantile_cont(list_max(v), 0.5) AS m FROM x_seg WHERE segment = 'one_off' GROUP BY 1) USING (tier)""", "forecast")(lambda w: ops.longtail_forecast(_cust_q(w)))


@query("f45_new_old_layering", f"""SELECT layer, count(*) AS products, sum(abs(p-a))/nullif(sum(abs(a)), 0) AS wape FROM (SELECT product_id, CASE WHEN fb > 7 THEN 'new' ELSE 'old' END AS layer, a, CASE WHEN fb > 7 THEN r3/3 ELSE al/11 END AS p FROM (SELECT product_id, {tot('revenue', f'{B} = 12')} AS a, {tot('revenue', f'{B} BETWEEN 9 AND 11')} AS r3, {tot('revenue', f'{B} BETWEEN 1 AND 11')} AS al FROM fact WHERE {_IN} GROUP BY 1)
  JOIN (SELECT product_id, {B.replace('month_idx', 'min(month_idx)')} AS fb FROM fact WHERE {_IN} GROUP BY 1) USING (product_id)) GROUP BY 1""", "wape")
def _f45(w):
    f = w.fact("product_id", "month_idx", "revenue", months=36)
    s = ops.quarter_series(f, ["product_id"], w.latest, ("revenue",)).withColumnRenamed("revenue", "v")
    return ops.layered_new_old(s, f.groupBy("product_id").agg(F.min(ops.bucket_of(w.latest)).alias("first_bucket")))


@query("f15_customer_scope", f"SELECT customer_id, tier, CASE WHEN tier IN ('KA','AA') THEN 'ranked' WHEN r > 1000000 THEN 'ranked' ELSE 'mean' END AS scope, r AS window_revenue FROM (SELECT customer_id, tier, {d('sum(revenue)')} AS r FROM fact WHERE {win(36)} GROUP BY 1, 2)", "window_revenue")
def _f15(w):
    g = w.fact("customer_id", "tier", "month_idx", "revenue", months=36).groupBy("customer_id", "tier").agg(dbl(F.sum("revenue")).alias("window_revenue"))
    return g.select("customer_id", "tier", F.when(F.col("tier").isin("KA", "AA") | (F.col("window_revenue") > 1_000_000), "ranked").otherwise("mean").alias("scope"), "window_revenue")


@query("f29_longtail_clusters")
def _f29(w):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    s = settle(ops.segment_customers(_cust_q(w)).filter(F.col("segment") == "active").select("customer_id", dbl("active_quarters").alias("active_quarters"), ops.asum(F.col("v")).alias("revenue"), ops.amean(ops.tail(F.col("v"), 4)).alias("recent")).orderBy("customer_id"))
    x = VectorAssembler(inputCols=["active_quarters", "revenue", "recent"], outputCol="raw").transform(s)
    x = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(x).transform(x)
    return KMeans(k=4, seed=42, maxIter=20).fit(x).transform(x).select("customer_id", "active_quarters", "revenue", "recent", F.col("prediction").alias("cluster"))


# --- further methods and studies ---
_MID = "greatest(least(i, len(v) - 7), 6)"
_TREND = f"list_avg(v[{_MID} - 5 : {_MID} + 6])"
query("f05_monthly_seasonal", f"""SELECT product_line, CASE WHEN len(v) >= 13 THEN ({' + '.join(f'v[len(v) - {k} + 1]/greatest(coalesce(season[(len(v) - {k}) % 12 + 1], 1), 1e-9)' for k in (1, 2, 3))})/3*coalesce(season[len(v) % 12 + 1], 1) ELSE list_avg(v[-3:]) END AS forecast FROM (
  SELECT product_line, v, list_transform(range(12), lambda m: list_aggregate(list_transform(list_filter(range(len(v)), lambda i: i % 12 = m AND {_TREND} > 0), lambda i: v[i + 1]/{_TREND}), 'median')) AS season FROM (SELECT product_line, list(v ORDER BY i) AS v FROM m_line GROUP BY 1))""", "forecast")(lambda w: _months(w).select("product_line", ops.monthly_seasonal(F.col("v")).alias("forecast")))
_HOLT = ", ".join(f"list_reduce(h[2:], lambda s, y: {{'e': s.e + power(y - s.l - s.t, 2), 'l': s.l + s.t + {a}*(y - s.l - s.t), 't': s.t + {a * b}*(y - s.l - s.t)}}, {{'e': CAST(0 AS DOUBLE), 'l': h[1], 't': CAST(0 AS DOUBLE)}})" for a, b in ((0.2, 0.1), (0.4, 0.1), (0.6, 0.2), (0.8, 0.3)))
cte("x_five", f"SELECT product_line, a, naive, mean_3, median_4, holt, list_aggregate([naive, mean_3, median_4, holt], 'median') AS ensemble FROM (SELECT product_line, v[t + 1] AS a, h[-1] AS naive, list_avg(h[-3:]) AS mean_3, list_aggregate(h[-4:], 'median') AS median_4, greatest(list_sort(list_transform([{_HOLT}], lambda x: {{'e': x.e, 'p': x.l + x.t}}))[1].p, 0) AS holt FROM (SELECT product_line, v, t, v[1:t] AS h FROM (SELECT product_line, list(revenue ORDER BY i) AS v FROM q_line GROUP BY 1), (SELECT unnest(range(8, 12)) AS t)))")
query("f26_five_methods", "SELECT *, row_number() OVER (PARTITION BY product_line ORDER BY round(mape, 10), method) AS rank FROM (SELECT product_line, method, avg(abs(p - a)/greatest(abs(a), 1e-9)) AS mape FROM (UNPIVOT x_five ON naive, mean_3, median_4, holt, ensemble INTO NAME method VALUE p) GROUP BY 1, 2)", "mape")(lambda w: ops.five_methods(_series(w).select("product_line", F.col("revenue").alias("v")), LINE))


@query("f28_extended_methods")
def _f28(w):
    m = ops.extended_methods(F.col("revenue"))
    return _series(w).select("product_line", *[e.alias(k) for k, e in m.items()])


@query("f30_forecast_extras")
def _f30(w):
    from ..operators import pricing

    f = w.fact("product_id", "month_idx", "qty", months=12)
    qty = ops.monthly_series(f, ["product_id"], w.latest - 11, w.latest, value="qty")
    return ops.forecast_extras(qty, ops.holiday_adjustment(_ratios(w), w.latest), pricing.price_elasticity(w.product_month(months=12)), pricing.order_frequency(w.fact("product_id", "month_idx", "order_id", months=12), "product_id", w.latest))


def _leaf(w, *keys):
    return ops.quarter_series(w.fact(*keys, "month_idx", "revenue", months=36), list(keys), w.latest, ("revenue",)).withColumnRenamed("revenue", "v")


_PM = "SELECT product_line, product_id, unnest([" + ", ".join(f"'{n}'" for n, _, _ in _M) + "]) AS method, unnest([" + ", ".join(_pred(a, p, "12") for _, a, p in _M) + "]) AS prediction FROM (SELECT product_line, product_id, i, greatest(coalesce(revenue, 0), 0) AS y FROM (SELECT DISTINCT product_line, product_id FROM q_prod) CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INT) AS i) LEFT JOIN (SELECT product_line, product_id, bucket AS i, revenue FROM q_prod) USING (product_line, product_id, i)) GROUP BY 1, 2"
query("f32_layer_predictions", f"SELECT product_line, method, sum(prediction) AS prediction, count(*) AS series FROM ({_PM}) GROUP BY 1, 2", "prediction")(lambda w: ops.layer_predictions(_leaf(w, "product_line", "product_id"), ["product_line", "product_id"], LINE))
query("f36_residual_quantiles", """SELECT product_line, max(p) AS forecast, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.9) AS p90 FROM (SELECT product_line, p, greatest(p + r[CAST(floor(CAST('0x' || substr(md5('42:' || product_line || ':' || k), 1, 8) AS BIGINT)*len(r)/4294967296.0) AS INT) + 1], 0) AS x FROM (
    SELECT product_line, any_value(c + s*13) AS p, list(y - c - s*i ORDER BY i) AS r FROM (SELECT product_line, i, revenue AS y, regr_intercept(revenue, i) OVER g AS c, regr_slope(revenue, i) OVER g AS s FROM q_line WINDOW g AS (PARTITION BY product_line)) GROUP BY 1), (SELECT unnest(range(1, 501)) AS k)) GROUP BY 1""", "forecast p10 p50 p90")(lambda w: ops.residual_quantiles(_leaf(w, "product_line"), LINE))
query("f37_interval_coverage", """WITH q AS (SELECT product_line, method, quantile_cont(actual/prediction, 0.1) FILTER (WHERE fold < 9 AND prediction > 0) AS lo, quantile_cont(actual/prediction, 0.9) FILTER (WHERE fold < 9 AND prediction > 0) AS hi FROM (SELECT product_line, method, fold, actual, nullif(prediction, 0) AS prediction FROM q_rows) GROUP BY 1, 2)
  SELECT product_line, method, CAST(count(*) FILTER (WHERE actual >= prediction*lo AND actual <= prediction*hi) AS DOUBLE)/count(*) AS coverage, avg(prediction*(hi-lo)/nullif(abs(actual),0)) AS relative_width FROM q_rows JOIN q USING (product_line, method) WHERE fold >= 9 GROUP BY 1, 2""", "coverage relative_width")(lambda w: ops.interval_coverage(settle(ops.metric_rows(ops.backtest(settle(_series(w)), LINE), LINE)), LINE))
query("f40_window_choice", """WITH r AS (SELECT *, CAST(replace(method, 'mean_', '') AS INT) AS k FROM q_rows WHERE method IN ('mean_2','mean_3','mean_4','mean_6')), b AS (SELECT product_line, k, wape FROM (SELECT *, row_number() OVER (PARTITION BY product_line ORDER BY round(wape, 10), k DESC) AS rn FROM (SELECT product_line, k, sum(abs_error)/greatest(sum(abs(actual)), 1e-9) AS wape FROM r GROUP BY 1, 2)) WHERE rn = 1),
  f AS (SELECT product_line, fold, k AS fk FROM (SELECT *, row_number() OVER (PARTITION BY product_line, fold ORDER BY round(abs_error, 6), k DESC) AS rn FROM r) WHERE rn = 1) SELECT b.*, agreement, agreement >= 2/3 AS stable FROM b JOIN (SELECT product_line, CAST(count(*) FILTER (WHERE fk = k) AS DOUBLE)/count(*) AS agreement FROM f JOIN b USING (product_line) GROUP BY 1) USING (product_line)""", "wape agreement")(
    lambda w: ops.window_choice(settle(ops.metric_rows(ops.backtest(settle(_series(w)), LINE), LINE)), LINE)
)


def _gran(name: str, cols: str) -> str:
    return f"SELECT '{name}' AS scheme, product_line, t, sum(coalesce(s, 0))/4 AS p FROM (SELECT {cols}, b AS bucket, CAST(sum(revenue) AS DOUBLE) AS s FROM (SELECT *, {B} AS b FROM fact WHERE {_IN}) GROUP BY {cols}, b) JOIN (SELECT CAST(unnest([9, 10, 11]) AS INT) AS t) ON bucket <= t AND bucket > t - 4 GROUP BY 2, 3"


@query("f41_granularity", f"SELECT product_line, scheme, sum(abs(p - revenue))/greatest(sum(abs(revenue)), 1e-9) AS wape FROM ({_gran('line', 'product_line')} UNION ALL {_gran('product', 'product_line, product_id')} UNION ALL {_gran('product_customer', 'product_line, product_id, customer_id')}) g JOIN q_line USING (product_line) WHERE q_line.i = g.t + 1 GROUP BY 1, 2", "wape")
def _f41(w):
    line = settle(_leaf(w, "product_line"))
    return ops.granularity({"line": line, "product": _leaf(w, "product_line", "product_id"), "product_customer": _leaf(w, "product_line", "product_id", "customer_id")}, line)


query("b46_forecast_dataset", f"""SELECT month_idx, v AS value, 'actual' AS kind, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high FROM co_month WHERE month_idx > {LM} - 36
  UNION ALL SELECT month_idx, forecast, 'forecast', forecast*lo, forecast*hi FROM co_ahead, (SELECT quantile_cont(ratio, 0.1) AS lo, quantile_cont(ratio, 0.9) AS hi FROM co_ratio)""", "value low high")(
    lambda w: ops.forecast_dataset(_company(w), ops.company_forecast(_company(w), _festival(w)), quantiles(_past_ratios(w), [], "ratio", {"p10": 0.1, "p90": 0.9}), 36)
)
