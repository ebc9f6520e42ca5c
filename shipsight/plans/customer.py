"""Customer metrics and the customer portrait."""

from ..operators import customer as ops
from ..operators import pricing
from .registry import cte, query
from .sqlbits import LM, avg, clip, cnt, d, ratio, tot, win

cte(
    "x_interval",
    """SELECT customer_id, CAST(sum(g) AS DOUBLE)/nullif(count(g),0) AS interval_days FROM (
      SELECT customer_id, CASE WHEN month_idx >= f + 6 THEN date_diff('day', lag(CASE WHEN month_idx >= f + 6 THEN month END) OVER (PARTITION BY customer_id ORDER BY month_idx), month) END AS g
      FROM (SELECT *, min(month_idx) OVER (PARTITION BY customer_id) AS f FROM cm)) GROUP BY 1""",
)
cte(
    "x_churn",
    f"""SELECT i.customer_id, interval_days, days_since, coalesce(days_since > interval_days * 1.5, FALSE) AS interrupted
    FROM x_interval i JOIN (SELECT customer_id, ({LM} - max(month_idx)) * CAST(30.4375 AS DOUBLE) AS days_since FROM cm GROUP BY 1) l USING (customer_id)""",
)
cte(
    "x_conc",
    """SELECT customer_id, CAST(sum(revenue) AS DOUBLE) AS revenue_total,
      CASE WHEN sum(revenue) > 0 THEN CAST(sum(revenue) FILTER (WHERE rn <= 5) AS DOUBLE)/CAST(sum(revenue) AS DOUBLE) ELSE 0 END AS top_share
    FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY revenue DESC, product_id, month_idx) AS rn FROM cpm) GROUP BY 1""",
)
cte(
    "x_cat",
    """SELECT t.customer_id, main_category, main_category_share, array_to_string(list_sort([x for x in w.a if NOT list_contains(b, x)]), '; ') AS unopened,
      CASE WHEN len([x for x in w.a if NOT list_contains(b, x)]) > 0 THEN 'watch_unopened' WHEN main_category_share > 0.6 THEN 'same_category_first' ELSE 'regular' END AS category_label
    FROM (SELECT customer_id, arg_max(category, rk) AS main_category, max(s) FILTER (WHERE rk = 0) AS main_category_share, list(category) AS b FROM (
        SELECT customer_id, category, CAST(v AS DOUBLE)/nullif(CAST(sum(v) OVER (PARTITION BY customer_id) AS DOUBLE),0) AS s,
          1 - row_number() OVER (PARTITION BY customer_id ORDER BY v DESC, category) AS rk
        FROM (SELECT customer_id, category, sum(revenue) AS v FROM cpm GROUP BY 1, 2)) GROUP BY 1) t,
      (SELECT list(category) AS a FROM (SELECT category FROM cpm GROUP BY 1 HAVING CAST(sum(revenue) AS DOUBLE) / (SELECT CAST(sum(revenue) AS DOUBLE) FROM cpm) > 0.10)) w""",
)
cte(
    "x_streak",
    f"""SELECT c.customer_id, coalesce(su, 0) AS streak_up, coalesce(sd, 0) AS streak_down FROM (SELECT DISTINCT customer_id FROM cm) c LEFT JOIN (
      SELECT customer_id, min(b) FILTER (WHERE NOT u) AS su, min(b) FILTER (WHERE u OR NOT dn) AS sd FROM (
        SELECT customer_id, coalesce({d('revenue')} > {d('p')} * 0.95, FALSE) AS u, coalesce(revenue < p, FALSE) AS dn, b FROM (
          SELECT *, lag(revenue) OVER (PARTITION BY customer_id ORDER BY month_idx) AS p, row_number() OVER (PARTITION BY customer_id ORDER BY month_idx DESC) - 1 AS b
          FROM cm WHERE {win(12)})) GROUP BY 1) s USING (customer_id)""",
)
_POS = "revenue > 0 AND "
cte(
    "x_mom",
    f"""SELECT customer_id, revenue_12m, profit_12m, qty_12m, revenue_prior_12m, profit_prior_12m, orders_12m,
      CASE WHEN revenue_12m > 0 THEN profit_12m/revenue_12m*100 ELSE 0 END AS margin_12m,
      {clip("CASE WHEN pc >= 2 THEN coalesce((rm-pmn)/pmn, -1) ELSE coalesce((coalesce(rs,0)-ps)/ps, 0) END", -1.0, 5.0)} AS growth,
      CASE WHEN qty_12m > 0 THEN revenue_12m/qty_12m ELSE 0 END AS asp,
      CASE WHEN pc >= 2 THEN (coalesce(rm,0)-pmn)/pmn ELSE 0 END AS yoy
    FROM (SELECT customer_id, {tot('revenue', win(12))} AS revenue_12m, {tot('profit', win(12))} AS profit_12m, {tot('qty', win(12))} AS qty_12m,
      {tot('revenue', win(12, 12))} AS revenue_prior_12m, {tot('profit', win(12, 12))} AS profit_prior_12m,
      CAST(coalesce(sum(orders) FILTER (WHERE {win(12)}), 0) AS BIGINT) AS orders_12m,
      {avg('revenue', _POS + win(12))} AS rm, {avg('revenue', _POS + win(12, 12))} AS pmn, {cnt(_POS + win(12, 12))} AS pc,
      {avg('revenue', _POS + win(6))} AS rs, {avg('revenue', _POS + win(6, 6))} AS ps FROM cm GROUP BY 1)""",
)
cte(
    "x_cover",
    """SELECT customer_id, count(*) AS products, CASE WHEN sum(v) > 0 THEN CAST(sum(v) FILTER (WHERE rn <= 1) AS DOUBLE)/CAST(sum(v) AS DOUBLE) ELSE 0 END AS top1_share,
      CASE WHEN sum(v) > 0 THEN CAST(sum(v) FILTER (WHERE rn <= 3) AS DOUBLE)/CAST(sum(v) AS DOUBLE) ELSE 0 END AS top3_share
    FROM (SELECT customer_id, product_id, sum(revenue) AS v, row_number() OVER (PARTITION BY customer_id ORDER BY sum(revenue) DESC, product_id) AS rn FROM cpm GROUP BY 1, 2) GROUP BY 1""",
)
cte(
    "x_lines",
    """SELECT customer_id, categories, CASE WHEN t > 0 THEN n ELSE 0 END AS lines, CASE WHEN t > 0 THEN ml ELSE 'none' END AS main_line,
      CASE WHEN t > 0 THEN ms ELSE 0 END AS main_line_share, CASE WHEN t > 0 THEN h ELSE 1 END AS line_hhi FROM (
      SELECT customer_id, max(t) AS t, count(*) AS n, sum(CASE WHEN s > 0 THEN s*s END) AS h, max(product_line) FILTER (WHERE rn = 1) AS ml, max(s) FILTER (WHERE rn = 1) AS ms FROM (
        SELECT *, CAST(v AS DOUBLE)/nullif(CAST(t AS DOUBLE),0) AS s FROM (
          SELECT customer_id, product_line, v, sum(v) OVER (PARTITION BY customer_id) AS t, row_number() OVER (PARTITION BY customer_id ORDER BY v DESC, product_line) AS rn
          FROM (SELECT customer_id, product_line, sum(revenue) AS v FROM cpm GROUP BY 1, 2))) GROUP BY 1)
      JOIN (SELECT customer_id, count(DISTINCT category) AS categories FROM cpm GROUP BY 1) USING (customer_id)""",
)
cte(
    "x_sku",
    f"""SELECT p.product_id, coalesce(s, 'intro') AS sku_stage FROM (SELECT DISTINCT product_id FROM pm) p LEFT JOIN (
      SELECT product_id, CASE WHEN n <= 3 AND q < 1000 THEN 'intro' WHEN n >= 3 AND falls >= 3 AND l3 < peak*0.3 AND r > 0 THEN 'exit'
        WHEN n >= 3 AND falls >= 3 AND l3 > 0 AND p3 > 0 AND l3 < p3*0.7 THEN 'hidden_decline' WHEN pa > 0 AND ra - pa > 0.15*pa THEN 'growth'
        WHEN n >= 6 THEN 'mature' ELSE 'intro' END AS s FROM (
        SELECT product_id, count(*) AS n, {d('sum(qty)')} AS q, {d('sum(revenue)')} AS r, {d('max(revenue)')} AS peak, {cnt('fell AND b <= 5')} AS falls,
          {tot('revenue', win(3))} AS l3, {tot('revenue', win(3, 3))} AS p3, coalesce({avg('revenue', win(3))}, 0) AS ra, coalesce({avg('revenue', win(3, 3))}, 0) AS pa
        FROM (SELECT *, lag(revenue) OVER (PARTITION BY product_id ORDER BY month_idx) > revenue AS fell, row_number() OVER (PARTITION BY product_id ORDER BY month_idx DESC) AS b
              FROM pm WHERE revenue > 0 OR qty > 0) GROUP BY 1)) z USING (product_id)""",
)
cte(
    "x_life",
    f"""SELECT customer_id, CASE WHEN since >= 18 THEN 'lost' WHEN since >= 6 THEN 'sleep' WHEN age <= 12 THEN 'intro' WHEN pa > 0 AND ra - pa > 0.05*pa THEN 'ramp'
        WHEN low3 AND coverage_months >= 3 AND avg12 > 0 THEN 'decline' ELSE 'mature' END AS lifecycle, coverage_months,
        CASE WHEN coverage_months < 6 THEN 'low' WHEN coverage_months < 18 THEN 'medium' ELSE 'high' END AS lifecycle_confidence FROM (
      SELECT customer_id, {LM} - max(month_idx) AS since, {LM} - min(month_idx) AS age, count(*) AS coverage_months, max(a) AS avg12,
        bool_and(coalesce({d('revenue')} < a * 0.85, FALSE)) FILTER (WHERE b <= 3) AS low3,
        coalesce({avg('revenue', win(3))}, 0) AS ra, coalesce({avg('revenue', win(3, 3))}, 0) AS pa FROM (
        SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY month_idx DESC) AS b,
          {d(f'sum(revenue) FILTER (WHERE {win(12)}) OVER (PARTITION BY customer_id)')} / nullif(count(*) FILTER (WHERE {win(12)}) OVER (PARTITION BY customer_id), 0) AS a FROM cm) GROUP BY 1)""",
)
cte(
    "x_new",
    f"""SELECT *, {d('count(*) FILTER (WHERE buys_new) OVER ()')} / count(*) OVER () AS new_penetration FROM (
      SELECT customer_id, coalesce({d('sum(revenue) FILTER (WHERE nw)')}, 0) AS new_revenue, count(DISTINCT product_id) FILTER (WHERE nw) AS new_products,
        coalesce({d('sum(revenue) FILTER (WHERE nw)')}, 0) / nullif({d('sum(revenue)')}, 0) AS new_share, coalesce({d('sum(revenue) FILTER (WHERE nw)')}, 0) > 0 AS buys_new
      FROM (SELECT cpm.*, coalesce(nw, FALSE) AS nw FROM cpm LEFT JOIN (SELECT product_id, bool_or(is_new) AS nw FROM pm WHERE {win(12)} GROUP BY 1) USING (product_id)) GROUP BY 1)""",
)


def _opp(months: int) -> str:
    return f"""SELECT customer_id, coalesce({ratio('k', '(SELECT count(*) FROM np)')}, 0) AS new_reach,
      CASE WHEN pa > 0 THEN (ra - pa)/pa ELSE 0 END AS momentum FROM (
        SELECT customer_id, coalesce({avg('revenue', win(3))}, 0) AS ra, coalesce({avg('revenue', win(3, 3))}, 0) AS pa FROM cm GROUP BY 1)
      LEFT JOIN (SELECT customer_id, count(DISTINCT product_id) AS k FROM cpm JOIN np USING (product_id) WHERE {win(12)} GROUP BY 1) USING (customer_id)""".replace(
        "np", f"(SELECT product_id FROM pm GROUP BY 1 HAVING min(month_idx) >= {LM} - {months})", 1
    ).replace("JOIN np USING", f"JOIN (SELECT product_id FROM pm GROUP BY 1 HAVING min(month_idx) >= {LM} - {months}) USING")


cte("x_opp", _opp(12))
cte(
    "x_risk",
    f"""SELECT customer_id, CASE WHEN t > 0 THEN coalesce({ratio('l', 't')}, 0) ELSE 0 END AS lost_share, CASE WHEN p3 > 0 THEN (p3 - r3)/p3 ELSE 0 END AS half_year_drop
    FROM (SELECT customer_id, {tot('revenue', 'b <= 3')} AS r3, {tot('revenue', 'b BETWEEN 4 AND 6')} AS p3
          FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY month_idx DESC) AS b FROM cm) GROUP BY 1)
    LEFT JOIN (SELECT customer_id, sum(r) FILTER (WHERE la <= {LM} - 3) AS l, sum(r) AS t FROM (
        SELECT customer_id, product_id, sum(revenue) AS r, max(month_idx) AS la FROM cpm WHERE {win(12)} GROUP BY 1, 2) GROUP BY 1) USING (customer_id)""",
)
cte(
    "x_stage",
    """SELECT customer_id, sku_stage AS main_sku_stage FROM (SELECT customer_id, sku_stage, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, sku_stage) AS rn
      FROM (SELECT DISTINCT customer_id, product_id FROM cpm) JOIN x_sku USING (product_id) GROUP BY 1, 2) WHERE rn = 1""",
)
cte(
    "x_asp",
    f"""SELECT customer_id, {clip(f"(asp - g)/g*100", -100.0, 100.0)} AS asp_gap_pct FROM x_mom,
      (SELECT {ratio('sum(revenue)', 'sum(qty)')} AS g FROM pm WHERE {win(12)})""",
)
cte(
    "x_margin",
    """SELECT customer_id, CASE WHEN revenue_prior_12m > 0 AND profit_prior_12m/revenue_prior_12m > 0
      THEN (margin_12m/100 - profit_prior_12m/revenue_prior_12m)/(profit_prior_12m/revenue_prior_12m)*100 ELSE 0 END AS margin_change_pct FROM x_mom""",
)
cte(
    "x_bands",
    """SELECT customer_id, low_revenue, mid_revenue, high_revenue, revenue, low_revenue/nullif(revenue,0) AS low_share, mid_revenue/nullif(revenue,0) AS mid_share,
      high_revenue/nullif(revenue,0) AS high_share FROM (
      SELECT customer_id, coalesce(CAST(sum(r) FILTER (WHERE band = 'low') AS DOUBLE),0) AS low_revenue, coalesce(CAST(sum(r) FILTER (WHERE band = 'mid') AS DOUBLE),0) AS mid_revenue,
        coalesce(CAST(sum(r) FILTER (WHERE band = 'high') AS DOUBLE),0) AS high_revenue, CAST(sum(r) AS DOUBLE) AS revenue FROM (
        SELECT customer_id, r, CASE WHEN p <= p25 THEN 'low' WHEN p <= p75 THEN 'mid' ELSE 'high' END AS band
        FROM (SELECT customer_id, product_id, avg(price) AS p, sum(revenue) AS r FROM cpm GROUP BY 1, 2)
        LEFT JOIN (SELECT product_id, quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.75) AS p75 FROM cpm GROUP BY 1) USING (product_id)) GROUP BY 1)""",
)
cte(
    "portrait",
    """SELECT * FROM x_mom JOIN cust USING (customer_id) JOIN x_streak USING (customer_id) JOIN x_cover USING (customer_id) JOIN x_lines USING (customer_id)
      JOIN x_churn USING (customer_id) JOIN (SELECT customer_id, revenue_total, top_share AS top5_share, top_share > 0.7 AS dependent FROM x_conc) USING (customer_id)
      JOIN (SELECT customer_id, low_share, mid_share, high_share FROM x_bands) USING (customer_id)
      JOIN (SELECT customer_id, main_category, main_category_share, category_label FROM x_cat) USING (customer_id)
      JOIN x_life USING (customer_id) JOIN x_new USING (customer_id) JOIN x_opp USING (customer_id) JOIN x_risk USING (customer_id) JOIN x_stage USING (customer_id)
      JOIN x_asp USING (customer_id) JOIN x_margin USING (customer_id)""",
)

MOM = "revenue_12m profit_12m qty_12m revenue_prior_12m profit_prior_12m margin_12m growth asp yoy"
PORTRAIT = (
    MOM + " top1_share top3_share main_line_share line_hhi interval_days days_since revenue_total top5_share low_share mid_share high_share"
    " main_category_share new_revenue new_share new_penetration new_reach momentum lost_share half_year_drop asp_gap_pct margin_change_pct"
)
_ALL = "SELECT * FROM "

query("a13_purchase_interval", _ALL + "x_interval", "interval_days")(lambda w: ops.purchase_interval(w.customer_month()))


@query("a14_churn_warning", _ALL + "x_churn", "interval_days days_since")
def _a14(w):
    cm = w.customer_month()
    return ops.churn_warning(cm, ops.purchase_interval(cm), w.latest)


@query("a15_product_concentration", "SELECT *, top_share > 0.7 AS dependent FROM x_conc", "revenue_total top_share")
def _a15(w):
    return ops.product_concentration(w.customer_product_month())


@query("a16_category_acceptance", _ALL + "x_cat", "main_category_share")
def _a16(w):
    return ops.category_acceptance(w.customer_product_month(extra=("category",)))


@query("a26_sku_lifecycle", _ALL + "x_sku")
def _a26(w):
    return ops.sku_lifecycle(w.product_month(), w.latest)


@query("a27_customer_lifecycle", _ALL + "x_life")
def _a27(w):
    return ops.customer_lifecycle(w.customer_month(), w.latest)


@query("a28_new_product_cohort", _ALL + "x_new", "new_revenue new_share new_penetration")
def _a28(w):
    return ops.new_product_cohort(w.product_month(), w.customer_product_month(), w.latest)


@query("a29_opportunity_signals", _opp(80), "new_reach momentum")
def _a29(w):
    return ops.opportunity_signals(w.customer_month(), w.product_month(), w.customer_product_month(), w.latest, months=80)


@query("a30_risk_signals", _ALL + "x_risk", "lost_share half_year_drop")
def _a30(w):
    return ops.risk_signals(w.customer_month(), w.customer_product_month(), w.latest)


@query("a31_momentum", _ALL + "x_mom", MOM)
def _a31(w):
    return ops.momentum(w.customer_month(), w.latest)


@query("a32_streaks", "SELECT * FROM x_streak")
def _a32(w):
    return ops.streaks(w.customer_month(), w.latest)


@query("a33_product_coverage", _ALL + "x_cover", "top1_share top3_share")
def _a33(w):
    return ops.product_coverage(w.customer_product_month())


@query("a34_line_distribution", _ALL + "x_lines", "main_line_share line_hhi")
def _a34(w):
    return ops.line_distribution(w.customer_product_month(extra=("product_line", "category")))


@query("a35_main_sku_stage", _ALL + "x_stage")
def _a35(w):
    return ops.main_sku_stage(w.customer_product_month(), ops.sku_lifecycle(w.product_month(), w.latest))


@query("a36_asp_gap", _ALL + "x_asp", "asp_gap_pct")
def _a36(w):
    return ops.asp_gap(ops.momentum(w.customer_month(), w.latest), w.product_month(months=12), w.latest)


@query("a37_margin_change", _ALL + "x_margin", "margin_change_pct")
def _a37(w):
    return ops.margin_change(ops.momentum(w.customer_month(), w.latest))


@query("a38_base_info", _ALL + "cust")
def _a38(w):
    return ops.base_info(w.customers())


@query("a39_customer_portrait", _ALL + "portrait", PORTRAIT)
def _a39(w):
    return ops.portrait(w.stored, pricing)


@query(
    "a40_top_concentration",
    f"""SELECT product_id, CASE WHEN n < 5 THEN 1.0 ELSE coalesce({ratio('t5', 't')}, 0) END AS top5_share, coalesce({ratio('t1', 't')}, 0) AS top1_share
    FROM (SELECT product_id, count(*) AS n, sum(v) AS t, sum(v) FILTER (WHERE rn <= 5) AS t5, sum(v) FILTER (WHERE rn = 1) AS t1 FROM (
      SELECT product_id, customer_id, sum(revenue) AS v, row_number() OVER (PARTITION BY product_id ORDER BY sum(revenue) DESC, customer_id) AS rn FROM cpm GROUP BY 1, 2) GROUP BY 1)""",
    "top5_share top1_share",
)
def _a40(w):
    return ops.top_n_concentration(w.fact("product_id", "customer_id", "revenue"), "product_id", "customer_id", 5)


@query(
    "a41_line_hhi",
    f"SELECT region, sum(CASE WHEN s > 0 THEN s*s END) AS hhi FROM (SELECT region, {ratio('v', 'sum(v) OVER (PARTITION BY region)')} AS s FROM (SELECT region, product_line, sum(revenue) AS v FROM fact GROUP BY 1, 2)) GROUP BY 1",
    "hhi",
)
def _a41(w):
    return ops.group_hhi(w.fact("region", "product_line", "revenue"), "region", "product_line")
