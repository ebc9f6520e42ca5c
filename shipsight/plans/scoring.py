"""Customer scores, journey and volatility."""

from pyspark.sql import functions as F

from ..operators import behaviour, customer, pricing
from ..operators import scoring as ops
from .customer import PORTRAIT
from .registry import cte, query
from .sqlbits import LM, clip, cnt, d, tot, win

_ALL = "SELECT * FROM "
cte(
    "x_volrow",
    f"""SELECT *, CASE WHEN y < before THEN (before - y)/greatest(before, 1) END AS f1, CASE WHEN nx > x + 1 AND y > 0 THEN y/greatest(y, 1) END AS f2 FROM (
      SELECT customer_id, x, y, CASE WHEN lag(x) OVER w = x - 1 THEN lag(y) OVER w WHEN x = 0 THEN NULL ELSE 0 END AS before, coalesce(lead(x) OVER w, (SELECT count(DISTINCT month_idx) FROM cm)) AS nx FROM (
        SELECT customer_id, {d('revenue')} AS y, x FROM cm JOIN (SELECT month_idx, {d('row_number() OVER (ORDER BY month_idx) - 1')} AS x FROM (SELECT DISTINCT month_idx FROM cm)) USING (month_idx))
      WINDOW w AS (PARTITION BY customer_id ORDER BY x))""",
)
cte(
    "x_vol",
    f"""SELECT *, CASE WHEN stability_score >= 70 THEN 'high' WHEN stability_score >= 40 THEN 'medium' ELSE 'volatile' END AS stability FROM (
      SELECT *, (CASE WHEN revenue_cv < 3 THEN 100 WHEN revenue_cv < 6 THEN 60 ELSE 20 END)*CAST(0.4 AS DOUBLE) + (CASE WHEN zero_share < 0.75 THEN 100 WHEN zero_share < 0.95 THEN 60 ELSE 20 END)*CAST(0.3 AS DOUBLE)
        + greatest(trend_r2, 0)*100*CAST(0.3 AS DOUBLE) AS stability_score FROM (
      SELECT customer_id, CASE WHEN sy/n > 0 THEN sqrt(greatest(syy - sy*sy/n, 0)/(n-1))/(sy/n) ELSE 999 END AS revenue_cv, max_drop, (n - nz)/n AS zero_share,
        CASE WHEN n >= 3 AND syy - sy*sy/n > 0 THEN (sxy - sx*sy/n)*(sxy - sx*sy/n)/((sxx - sx*sx/n)*(syy - sy*sy/n)) ELSE 0 END AS trend_r2 FROM (
        SELECT customer_id, sum(y) AS sy, sum(y*y) AS syy, sum(x*y) AS sxy, coalesce(greatest(max(f1), max(f2)), max(f1), max(f2), 0) AS max_drop, count(*) FILTER (WHERE y <> 0) AS nz FROM x_volrow GROUP BY 1),
        (SELECT {d('count(*)')} AS n, sum(x) AS sx, sum(x*x) AS sxx FROM (SELECT {d('row_number() OVER (ORDER BY month_idx) - 1')} AS x FROM (SELECT DISTINCT month_idx FROM cm)))))""",
)
query("r31_volatility", _ALL + "x_vol", "revenue_cv max_drop zero_share trend_r2 stability_score")(lambda w: behaviour.volatility(w.customer_month()))

cte(
    "x_jraw",
    f"""SELECT *, CASE WHEN p6 > 0 THEN (r6-p6)/greatest(p6,1) ELSE 0 END AS growth_6m, CASE WHEN p3 > 0 THEN r3/greatest(p3,1) ELSE 0 END AS revenue_surge,
      CASE WHEN n12 > 1 THEN s12/greatest(m12,1) ELSE 999 END AS cv_12m, CASE WHEN n6 > 0 THEN coalesce(run, 0) ELSE 0 END AS falls FROM (
      SELECT customer_id, {LM} - max(month_idx) AS since, {LM} - min(month_idx) AS age, min(month) AS first_month, sum(orders) AS orders, max(gap) AS max_gap,
        {tot('revenue', win(6))} AS r6, {tot('revenue', win(6, 6))} AS p6, {tot('revenue', win(3))} AS r3, {tot('revenue', win(3, 3))} AS p3,
        avg({d('revenue')}) FILTER (WHERE {win(12)}) AS m12, stddev_samp({d('revenue')}) FILTER (WHERE {win(12)}) AS s12, {cnt(win(12))} AS n12, {cnt(win(6))} AS n6, min(back - 1) FILTER (WHERE NOT fell) AS run FROM (
        SELECT *, month_idx - lag(month_idx) OVER w AS gap, coalesce({win(6)} AND revenue < lag(revenue) OVER w AND lag(month_idx) OVER w > {LM} - 6, FALSE) AS fell,
          row_number() OVER (PARTITION BY customer_id ORDER BY month_idx DESC) AS back FROM cm WINDOW w AS (PARTITION BY customer_id ORDER BY month_idx)) GROUP BY 1)""",
)
cte(
    "x_jrn0",
    """SELECT j.*, channel, CASE WHEN max_gap > 6 AND since <= 1 THEN 'reactivated' WHEN age <= 6 AND orders <= 3 THEN 'onboarding' WHEN since > 6 AND r6 = 0 THEN 'lost'
      WHEN growth_6m <= -0.2 AND falls >= 2 THEN 'decline' WHEN growth_6m >= 0.3 OR revenue_surge >= 2 THEN 'growth' WHEN cv_12m < 0.3 THEN 'mature' ELSE 'stable' END AS j0 FROM x_jraw j LEFT JOIN cust USING (customer_id)""",
)
cte(
    "x_jrn",
    """SELECT customer_id, CASE WHEN j0 = 'mature' AND r6 < bar THEN 'stable' ELSE j0 END AS journey, first_month, CAST(since*30 AS BIGINT) AS days_since, growth_6m, cv_12m, falls, r6 AS revenue_6m
    FROM x_jrn0 LEFT JOIN (SELECT channel, quantile_cont(r6, 0.7) AS bar FROM x_jrn0 WHERE r6 > 0 GROUP BY 1) USING (channel)""",
)
cte(
    "x_hist",
    """SELECT customer_id, month_idx, i, n, CASE WHEN y = 0 THEN 'lost' WHEN i - coalesce(f, i) <= 6 THEN 'onboarding' WHEN f2 IS NOT NULL AND falls >= 2 THEN 'decline' WHEN f2 IS NOT NULL AND falls >= 1 THEN 'warning'
      WHEN f2 IS NOT NULL AND rises >= 2 THEN 'ramp' ELSE 'stable' END AS row_stage FROM (
      SELECT *, min(CASE WHEN y > 0 THEN i END) OVER (PARTITION BY customer_id) AS f, coalesce(CAST(f2 < f1*0.9 AS INT), 0) + coalesce(CAST(f3 < f2*0.9 AS INT), 0) AS falls,
        coalesce(CAST(f2 > f1*1.1 AS INT), 0) + coalesce(CAST(f3 > f2*1.1 AS INT), 0) AS rises FROM (
        SELECT customer_id, month_idx, y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY customer_id) AS n, lead(y, 1) OVER w AS f1, lead(y, 2) OVER w AS f2, lead(y, 3) OVER w AS f3
        FROM (SELECT customer_id, month_idx, CAST(revenue AS DOUBLE) AS y FROM cm) WINDOW w AS (PARTITION BY customer_id ORDER BY month_idx))) WHERE n >= 3 AND i >= n - 12""",
)
cte(
    "x_journey",
    """SELECT j.*, coalesce(stage_months, 1) AS stage_months, coalesce(stage_changes, 0) AS stage_changes FROM x_jrn j LEFT JOIN (
      SELECT customer_id, CAST(greatest(coalesce(min(back) FILTER (WHERE NOT same), max(k)), 1) AS INT) AS stage_months, count(*) FILTER (WHERE moved) AS stage_changes FROM (
        SELECT customer_id, n - 1 - i AS back, row_stage = journey AS same, row_stage <> lag(row_stage) OVER (PARTITION BY customer_id ORDER BY month_idx) AS moved, count(*) OVER (PARTITION BY customer_id) AS k
        FROM x_hist JOIN x_jrn USING (customer_id)) GROUP BY 1) USING (customer_id)""",
)


@query("r32_journey_stage", _ALL + "x_journey", "growth_6m cv_12m revenue_6m")
def _r32(w):
    return behaviour.journey_full(w.customer_month(), w.latest, w.customers("channel"))


@query("r33_historical_stages", "SELECT customer_id, month_idx, row_stage FROM x_hist")
def _r33(w):
    return behaviour.historical_stages(w.customer_month()).select("customer_id", "month_idx", "row_stage")


@query("w14_max_gap", "SELECT customer_id, max(g) AS max_gap FROM (SELECT customer_id, month_idx - lag(month_idx) OVER (PARTITION BY customer_id ORDER BY month_idx) AS g FROM cm) GROUP BY 1")
def _w14(w):
    from pyspark.sql import Window

    g = F.col("month_idx") - F.lag("month_idx").over(Window.partitionBy("customer_id").orderBy("month_idx"))
    return w.customer_month().select("customer_id", g.alias("g")).groupBy("customer_id").agg(F.max("g").alias("max_gap"))


cte(
    "x_pareto",
    """SELECT p.customer_id, cumulative_pct, coalesce(CASE WHEN cumulative_pct <= 70 AND t > 0 THEN 'A' WHEN cumulative_pct <= 90 AND t > 0 THEN 'B' WHEN cumulative_pct <= 99 AND t > 0 THEN 'C' ELSE 'D' END, 'D') AS pareto FROM x_mom p LEFT JOIN (
      SELECT customer_id, CAST(sum(CAST(profit_12m AS DECIMAL(18,4))) OVER (ORDER BY profit_12m DESC, customer_id ROWS UNBOUNDED PRECEDING) AS DOUBLE)/CAST(sum(CAST(profit_12m AS DECIMAL(18,4))) OVER () AS DOUBLE)*100 AS cumulative_pct,
        sum(CAST(profit_12m AS DECIMAL(18,4))) OVER () AS t FROM x_mom WHERE revenue_12m > 0) USING (customer_id)""",
)


@query("w09_pareto_tiers", _ALL + "x_pareto", "cumulative_pct")
def _w09(w):
    return ops.pareto_tiers(customer.momentum(w.customer_month(), w.latest))


def _qcut(src: str, key: str, col: str, part: str | None, up: bool, dense: bool, out: str) -> str:
    pb = f"PARTITION BY {part}" if part else ""
    rank = f"CAST(dense_rank() OVER ({pb} ORDER BY {col}) AS DOUBLE)" if dense else f"CAST({col} AS DOUBLE)"
    lab = [str(i if up else 6 - i) for i in range(1, 6)]
    edges = ", ".join(f"quantile_cont(dr, {i / 5}) AS e{i}" for i in range(6))
    grp = f"SELECT {part}, {edges} FROM r GROUP BY 1" if part else f"SELECT {edges} FROM r"
    join = f"JOIN e USING ({part})" if part else "CROSS JOIN e"
    inc = " AND ".join(f"e{i} < e{i + 1}" for i in range(5))
    return f"""(WITH r AS (SELECT {key}{', ' + part if part else ''}, {rank} AS dr FROM {src} WHERE {col} IS NOT NULL), e AS ({grp})
      SELECT {key}, CASE WHEN NOT ({inc}) THEN 3 WHEN dr <= e1 THEN {lab[0]} WHEN dr <= e2 THEN {lab[1]} WHEN dr <= e3 THEN {lab[2]} WHEN dr <= e4 THEN {lab[3]} ELSE {lab[4]} END AS {out} FROM r {join})"""


cte("x_rfm0", f"SELECT customer_id, date_diff('day', max(ship_date), (SELECT max(ship_date) FROM fact)) AS recency, count(DISTINCT ship_date) AS frequency, {d('sum(revenue)')} AS money FROM fact GROUP BY 1")


@query(
    "r05_rfm_segments",
    f"""SELECT *, r_score + f_score + m_score AS rfm_total, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'key_value' WHEN r_score >= 4 AND f_score >= 4 THEN 'key_develop' WHEN f_score >= 4 AND m_score >= 4 THEN 'key_keep'
      WHEN r_score < 4 AND f_score < 4 AND m_score >= 4 THEN 'key_retain' WHEN r_score >= 4 AND f_score < 4 AND m_score < 4 THEN 'new' ELSE 'general' END AS segment, recency > 90 AS churned
    FROM x_rfm0 JOIN {_qcut('x_rfm0', 'customer_id', 'recency', None, False, False, 'r_score')} USING (customer_id) JOIN {_qcut('x_rfm0', 'customer_id', 'frequency', None, True, False, 'f_score')} USING (customer_id)
    JOIN {_qcut('x_rfm0', 'customer_id', 'money', None, True, False, 'm_score')} USING (customer_id)""",
    "money",
)
def _r05(w):
    return ops.rfm(w.fact("customer_id", "ship_date", "revenue"))


def _rfmpi(part, weights) -> str:
    src = "(SELECT customer_id, channel, days_since, interval_days, profit_12m, new_share FROM x_mom JOIN cust USING (customer_id) JOIN x_churn USING (customer_id) JOIN x_new USING (customer_id))"
    cols = (("days_since", "r", False), ("interval_days", "f", False), ("profit_12m", "m", True), ("new_share", "p", True))
    joins = " ".join(f"LEFT JOIN {_qcut(src, 'customer_id', c, part, up, True, o)} USING (customer_id)" for c, o, up in cols)
    return f"""SELECT *, CASE WHEN rfm_pi >= 4 THEN 'S' WHEN rfm_pi >= 3.5 THEN 'A' WHEN rfm_pi >= 2.5 THEN 'B' ELSE 'C' END AS rfm_pi_tier FROM (
      SELECT customer_id, channel, r_score, f_score, m_score, p_score, {weights} AS rfm_pi FROM (SELECT customer_id, channel, coalesce(r, 3) AS r_score, coalesce(f, 3) AS f_score, coalesce(m, 3) AS m_score, coalesce(p, 3) AS p_score FROM {src} {joins}))"""


_W_CH = " + ".join(f"(CASE channel WHEN 'direct' THEN CAST({a} AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END) * {x}_score" for a, x in zip((0.3, 0.2, 0.3, 0.2), "rfmp"))
cte("x_rfmpi", _rfmpi("channel", _W_CH))


@query("r06_rfm_pi", _ALL + "x_rfmpi", "rfm_pi")
def _r06(w):
    cm = w.customer_month()
    p = customer.momentum(cm, w.latest).join(customer.base_info(w.customers()), "customer_id").join(
        customer.churn_warning(cm, customer.purchase_interval(cm), w.latest), "customer_id"
    ).join(customer.new_product_cohort(w.product_month(), w.customer_product_month(), w.latest), "customer_id")
    return ops.rfm_pi(p)


def _points(col, table, default=50):
    return f"(CASE {col} {' '.join(f'''WHEN '{k}' THEN {v}''' for k, v in table.items())} ELSE {default} END)"


cte(
    "sp0",
    f"""SELECT p.*, journey, growth_6m, cv_12m, falls, revenue_6m, stage_months, stage_changes, revenue_cv, max_drop, zero_share, trend_r2, v.stability_score AS volatility_points, stability, rfm_pi, rfm_pi_tier, pareto, order_cost,
      profit_12m - order_cost AS true_profit, (profit_12m - order_cost)/greatest(revenue_12m, 1)*100 AS true_margin,
      CASE WHEN (profit_12m - order_cost)/greatest(revenue_12m, 1)*100 >= 35 THEN 'high' WHEN (profit_12m - order_cost)/greatest(revenue_12m, 1)*100 > 0 THEN 'thin' ELSE 'loss' END AS profit_level,
      {_points('lifecycle', ops.LIFECYCLE_POINTS)} AS lifecycle_points, {_points('stability', ops.STABILITY_POINTS)} AS stability_points, {_points('tier', ops.TIER_POINTS)} AS tier_points, CASE WHEN interrupted THEN 100 ELSE 0 END AS interrupted_points
    FROM (SELECT *, CASE WHEN revenue_12m > 0 THEN {d('orders_12m')}*50 ELSE 0 END AS order_cost FROM portrait) p JOIN x_journey USING (customer_id) JOIN x_vol v USING (customer_id) JOIN x_rfmpi USING (customer_id) JOIN x_pareto USING (customer_id)""",
)


def _dim(ind) -> str:
    parts = []
    for n, (w, rev) in ind.items():
        lo, hi = f"(SELECT min({n}) FROM sp0 WHERE revenue_12m > 0)", f"(SELECT max({n}) FROM sp0 WHERE revenue_12m > 0)"
        num = f"(CAST({hi} AS DOUBLE) - {n})" if rev else f"(CAST({n} AS DOUBLE) - {lo})"
        parts.append(f"(CASE WHEN revenue_12m > 0 THEN CASE WHEN {lo} < {hi} THEN coalesce({num}/(CAST({hi} AS DOUBLE) - {lo})*100, 0) ELSE 50 END ELSE 18 END) * CAST({w} AS DOUBLE)")
    return f"({' + '.join(parts)})/CAST({sum(w for w, _ in ind.values())} AS DOUBLE)"


cte("sp1", "SELECT *, " + ", ".join(f"{_dim(i)} AS {n}_score" for n, i in ops.DIMENSIONS.items()) + " FROM sp0")
cte(
    "sp",
    f"""SELECT s.* EXCLUDE (lifecycle_points, stability_points, tier_points, interrupted_points), CASE WHEN revenue_12m > 0 THEN CASE WHEN composite >= 34 THEN 'S' WHEN composite >= 28 THEN 'A' WHEN composite >= 22 THEN 'B' ELSE 'C' END ELSE 'dormant' END AS value_tier,
      CASE WHEN revenue_12m <= 0 THEN 'inactive' WHEN revenue_12m < r25 THEN 'slightly_active' ELSE 'active' END AS activity,
      CASE WHEN opportunity >= 27 THEN 'very_high' WHEN opportunity >= 20 THEN 'high' WHEN opportunity >= 13 THEN 'medium' ELSE 'low' END AS opportunity_level,
      CASE WHEN risk >= 85 THEN 'very_high' WHEN risk >= 78 THEN 'high' WHEN risk >= 60 THEN 'medium' ELSE 'low' END AS customer_risk,
      CASE WHEN revenue_12m <= 0 THEN 'inactive' WHEN value_score >= v50 AND growing_score >= g50 THEN 'star' WHEN growing_score >= g50 THEN 'potential' WHEN value_score >= v50 THEN 'cash_cow' ELSE 'dog' END AS dual_axis
    FROM (SELECT *, {' + '.join(f'{n}_score*CAST({w} AS DOUBLE)' for n, w in ops.DIMENSION_WEIGHTS.items())} AS composite, growing_score*CAST(0.6 AS DOUBLE) + potential_score*CAST(0.4 AS DOUBLE) AS opportunity,
      (100 - stability_score)*CAST(0.7 AS DOUBLE) + (100 - efficiency_score)*CAST(0.3 AS DOUBLE) AS risk FROM sp1) s,
      (SELECT quantile_cont(revenue_12m, 0.25) AS r25, quantile_cont(value_score, 0.5) AS v50, quantile_cont(growing_score, 0.5) AS g50 FROM sp1 WHERE revenue_12m > 0)""",
)
_SC = "customer_id, revenue_12m, value_score, growing_score, stability_score, potential_score, efficiency_score, composite, opportunity, risk, value_tier, activity, opportunity_level, customer_risk, dual_axis, pareto, profit_level, journey, stability"


@query("r03_composite_scores", f"SELECT {_SC} FROM sp", "revenue_12m value_score growing_score stability_score potential_score efficiency_score composite opportunity risk")
def _r03(w):
    return w.scored_portrait().select(*[x.strip() for x in _SC.split(",")])


@query("r04_customer_tier", "SELECT customer_id, tier, CASE WHEN tier IN ('KA','AA','KM','MM') THEN tier ELSE 'unclassified' END AS tier_class FROM cust")
def _r04(w):
    return ops.customer_tier(w.customers("tier"))


@query(
    "a50_true_profit",
    f"""SELECT *, CASE WHEN true_margin >= 35 THEN 'high' WHEN true_margin > 0 THEN 'thin' ELSE 'loss' END AS profit_level FROM (SELECT customer_id, order_cost, profit_12m - order_cost AS true_profit, (profit_12m - order_cost)/greatest(revenue_12m, 1)*100 AS true_margin
      FROM (SELECT *, CASE WHEN revenue_12m > 0 THEN {d('orders_12m')}*50 ELSE 0 END AS order_cost FROM x_mom))""",
    "order_cost true_profit true_margin",
)
def _a50(w):
    return ops.true_profit(customer.momentum(w.customer_month(), w.latest)).select("customer_id", "order_cost", "true_profit", "true_margin", "profit_level")


@query(
    "c26_percentile_clip",
    "SELECT customer_id, least(greatest(growth, gl), gh) AS growth, least(greatest(yoy, yl), yh) AS yoy FROM x_mom, (SELECT quantile_cont(growth, 0.01) AS gl, quantile_cont(growth, 0.99) AS gh, quantile_cont(yoy, 0.01) AS yl, quantile_cont(yoy, 0.99) AS yh FROM x_mom)",
    "growth yoy",
)
def _c26(w):
    return ops.clip_to_percentiles(customer.momentum(w.customer_month(), w.latest).select("customer_id", "growth", "yoy"), ["growth", "yoy"])


@query("w10_percent_rank", "SELECT customer_id, margin_12m, (rank() OVER (ORDER BY margin_12m) + (count(*) OVER (PARTITION BY margin_12m) - 1)/2.0)/count(*) OVER () AS pct FROM x_mom", "margin_12m pct")
def _w10(w):
    from ..functions.distribution import pct_rank

    return pct_rank(customer.momentum(w.customer_month(), w.latest).select("customer_id", "margin_12m"), [], "margin_12m", "pct")


@query("w11_equal_depth_scores", "SELECT c.customer_id, tier, revenue_12m, coalesce(score, 3) AS score FROM (SELECT customer_id, tier, revenue_12m FROM x_mom JOIN cust USING (customer_id)) c LEFT JOIN "
       + _qcut("(SELECT customer_id, tier, revenue_12m FROM x_mom JOIN cust USING (customer_id))", "customer_id", "revenue_12m", "tier", True, True, "score") + " USING (customer_id)", "revenue_12m")
def _w11(w):
    from ..functions.distribution import equal_depth

    m = customer.momentum(w.customer_month(), w.latest).join(w.customers("tier"), "customer_id").select("customer_id", "tier", "revenue_12m")
    return equal_depth(m, ["tier"], "revenue_12m", "score")


@query("w12_equal_depth_cut", "SELECT customer_id, revenue_12m, bin FROM x_mom JOIN " + _qcut("x_mom", "customer_id", "revenue_12m", None, True, False, "bin") + " USING (customer_id)", "revenue_12m")
def _w12(w):
    from ..functions.distribution import equal_depth

    return equal_depth(customer.momentum(w.customer_month(), w.latest).select("customer_id", "revenue_12m"), [], "revenue_12m", "bin", dense=False)


@query("r01_minmax_score", "SELECT customer_id, (revenue_12m - lo)/(hi - lo)*100 AS score, (hi - revenue_12m)/(hi - lo)*100 AS reversed FROM x_mom, (SELECT min(revenue_12m) AS lo, max(revenue_12m) AS hi FROM x_mom)", "score reversed")
def _r01(w):
    from ..functions.distribution import minmax_score, one_row

    m = customer.momentum(w.customer_month(), w.latest).select("customer_id", "revenue_12m")
    m = m.withColumn("s", one_row(m.agg(F.min("revenue_12m").alias("lo"), F.max("revenue_12m").alias("hi"))))
    lo, hi = F.col("s.lo"), F.col("s.hi")
    return m.select("customer_id", minmax_score("revenue_12m", lo, hi).alias("score"), minmax_score("revenue_12m", lo, hi, True).alias("reversed"))


query("r02_dimension_scores", "SELECT customer_id, value_score, growing_score, stability_score, potential_score, efficiency_score FROM sp1", "value_score growing_score stability_score potential_score efficiency_score")(
    lambda w: w.scored_portrait().select("customer_id", "value_score", "growing_score", "stability_score", "potential_score", "efficiency_score")
)
query("r60_dual_axis", "SELECT customer_id, value_score, growing_score, dual_axis FROM sp", "value_score growing_score")(lambda w: w.scored_portrait().select("customer_id", "value_score", "growing_score", "dual_axis"))
