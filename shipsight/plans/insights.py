"""Inventory, margins, product mix, owners, associations."""

from pyspark.sql import functions as F

from ..operators import customer
from ..operators import insights as ops
from .registry import cte, query
from .sqlbits import LM, clip, cnt, d, ratio, tot, win

_A = "SELECT * FROM "
_SH = [f"(CASE WHEN act >= 6 THEN {a} WHEN act >= 3 THEN {b} WHEN act >= 1 THEN {c} ELSE {e} END)" for a, b, c, e in ((0.8, 0.5, 0.2, 0.1), (0.15, 0.3, 0.4, 0.3), (0.05, 0.2, 0.4, 0.6))]
cte(
    "x_aging",
    f"""SELECT product_id, s AS stock, s*{_SH[0]} AS under_180d, s*{_SH[1]} AS d180_to_1y, s*{_SH[2]} AS over_1y, {d(_SH[1])} + {d(_SH[2])} AS over_180d_share, {d(_SH[2])} AS over_1y_share, TRUE AS estimated FROM (
      SELECT product_id, {d(f'sum(qty) FILTER (WHERE {win(3)})')}/3*2 AS s, {cnt(win(6))} AS act FROM pm GROUP BY 1) WHERE s IS NOT NULL""",
)
_AG = "stock under_180d d180_to_1y over_1y over_180d_share over_1y_share"
query("a48_inventory_estimate", _A + "x_aging", _AG)(lambda w: ops.estimate_aging(w.product_month(months=12), w.latest))
query("a65_aging_source", _A + "x_aging", _AG)(lambda w: ops.choose_aging(w.product_month(months=12), w.latest))
cte(
    "x_invrisk",
    f"""SELECT customer_id, stagnant_rows, dead_rows, CASE WHEN t > 0 THEN s/t ELSE 0 END AS stagnant_share, CASE WHEN t > 0 THEN dd/t ELSE 0 END AS dead_share, CASE WHEN t > 0 THEN ww/t ELSE 0 END AS over_180d_weighted FROM (
      SELECT customer_id, {cnt('a > 0.3')} AS stagnant_rows, {cnt('b > 0.1')} AS dead_rows, {tot('revenue', 'a > 0.3')} AS s, {tot('revenue', 'b > 0.1')} AS dd, sum(a*{d('revenue')}) AS ww, {d('sum(revenue)')} AS t
      FROM (SELECT cpm.*, coalesce(over_180d_share, 0) AS a, coalesce(over_1y_share, 0) AS b FROM cpm LEFT JOIN x_aging USING (product_id)) GROUP BY 1)""",
)


@query("a49_customer_inventory_risk", _A + "x_invrisk", "stagnant_share dead_share over_180d_weighted")
def _a49(w):
    return ops.customer_inventory_risk(w.customer_product_month(), ops.estimate_aging(w.product_month(months=12), w.latest))


@query(
    "j14_bom_explosion",
    f"""SELECT product_id, under_180d, d180_to_1y, over_1y, under_180d+d180_to_1y+over_1y AS stock, coalesce((d180_to_1y+over_1y)/nullif(under_180d+d180_to_1y+over_1y,0),0) AS over_180d_share, coalesce(over_1y/nullif(under_180d+d180_to_1y+over_1y,0),0) AS over_1y_share, FALSE AS estimated
    FROM (SELECT product_id, sum(u*wt) AS under_180d, sum(v*wt) AS d180_to_1y, sum(o*wt) AS over_1y FROM (
      SELECT *, CASE WHEN sum(q) OVER (PARTITION BY material_id) > 0 THEN q/sum(q) OVER (PARTITION BY material_id) ELSE CAST(1 AS DOUBLE)/count(*) OVER (PARTITION BY material_id) END AS wt FROM (
        SELECT b.material_id, b.product_id, u, v, o, coalesce({d('s.q')}, 0) AS q FROM (SELECT DISTINCT p_brand AS material_id, p_partkey AS product_id FROM part) b
        JOIN (SELECT p_brand AS material_id, {d('sum(p_size)')} AS u, {d('sum(p_size)')}*0.5 AS v, {d('sum(p_size)')}*0.25 AS o FROM part GROUP BY 1) USING (material_id)
        LEFT JOIN (SELECT product_id, sum(qty) AS q FROM pm WHERE {win(12)} GROUP BY 1) s ON b.product_id = s.product_id)) GROUP BY 1)""",
    _AG,
)
def _j14(w):
    from ..sources.fact import table

    part = table(w.spark, w.folder, "part")
    bom = part.select(F.col("p_brand").alias("material_id"), F.col("p_partkey").alias("product_id"))
    u = F.sum("p_size").cast("double")
    inv = part.groupBy(F.col("p_brand").alias("material_id")).agg(u.alias("under_180d"), (u * 0.5).alias("d180_to_1y"), (u * 0.25).alias("over_1y"))
    return ops.explode_to_finished(inv, bom, w.product_month(months=12), w.latest)


cte("x_cp", "SELECT customer_id, product_id, revenue, profit, CASE WHEN revenue > 0 THEN CAST(profit AS DOUBLE)/CAST(revenue AS DOUBLE)*100 ELSE 0 END AS margin FROM (SELECT customer_id, product_id, sum(revenue) AS revenue, sum(profit) AS profit FROM cpm GROUP BY 1, 2)")
cte(
    "x_neg",
    f"""SELECT g.*, worst_products, CASE WHEN severity = 'none' THEN '' WHEN overall_margin < 0 THEN 'urgent: review pricing' WHEN severity = 'severe' THEN 'stop or reprice loss products' WHEN severity = 'watch' THEN 'review loss products one by one' ELSE 'adjust price when possible' END AS advice FROM (
      SELECT customer_id, products, loss_products, loss_product_pct, revenue, overall_margin, loss, greatest(-loss, 0) AS recoverable, CASE WHEN sv = 'severe' AND revenue_12m <= 0 THEN 'watch' ELSE sv END AS severity FROM (
        SELECT *, CASE WHEN loss_products = 0 THEN 'none' WHEN abs(loss) > 150000 THEN 'severe' WHEN overall_margin < 0 THEN 'severe' WHEN abs(loss) > 100000 THEN 'watch' WHEN loss_product_pct > 30 OR (revenue > 0 AND abs(loss)/revenue > 0.1) THEN 'severe'
          WHEN loss_product_pct > 15 OR (revenue > 0 AND abs(loss)/revenue > 0.05) THEN 'watch' ELSE 'slight' END AS sv FROM (
          SELECT customer_id, count(*) AS products, {cnt('margin < 0')} AS loss_products, {d(cnt('margin < 0'))}/count(*)*100 AS loss_product_pct, {d('sum(revenue)')} AS revenue,
            CASE WHEN sum(revenue) > 0 THEN {d('sum(profit)')}/{d('sum(revenue)')}*100 ELSE 0 END AS overall_margin, {tot('profit', 'margin < 0')} AS loss FROM x_cp GROUP BY 1)) JOIN (SELECT customer_id, revenue_12m FROM x_mom) USING (customer_id)) g
    LEFT JOIN (SELECT customer_id, string_agg(CAST(product_id AS VARCHAR), '; ' ORDER BY rn) AS worst_products FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY profit, product_id) AS rn FROM x_cp WHERE margin < 0) WHERE rn <= 20 GROUP BY 1) USING (customer_id)""",
)


@query("a47_negative_margin", _A + "x_neg", "loss_product_pct revenue overall_margin loss recoverable")
def _a47(w):
    return ops.negative_margin(w.customer_product_month(), customer.momentum(w.customer_month(), w.latest))


_TOP = "(SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY revenue DESC, product_id) AS rn FROM x_cp)"
cte("x_cpt", "SELECT customer_id, sum(revenue) AS tr, sum(profit) AS tp, CASE WHEN sum(revenue) > 0 THEN CAST(sum(profit) AS DOUBLE)/CAST(sum(revenue) AS DOUBLE)*100 ELSE 0 END AS om, count(*) AS products FROM x_cp GROUP BY 1")


@query(
    "a51_product_profiles",
    f"""SELECT customer_id, CAST(tr AS DOUBLE) AS revenue, CAST(tp AS DOUBLE) AS profit, products, om AS overall_margin, main_line, top_products, best_products, loss_products FROM x_cpt
    JOIN (SELECT customer_id, main_line FROM (SELECT customer_id, product_line AS main_line, row_number() OVER (PARTITION BY customer_id ORDER BY sum(revenue) DESC, product_line) AS rn FROM cpm GROUP BY 1, 2) WHERE rn = 1) USING (customer_id)
    LEFT JOIN (SELECT customer_id, string_agg(CAST(product_id AS VARCHAR), ';' ORDER BY rn) AS top_products FROM {_TOP} WHERE rn <= 5 GROUP BY 1) USING (customer_id)
    LEFT JOIN (SELECT customer_id, string_agg(CAST(product_id AS VARCHAR), ';' ORDER BY rn) AS best_products FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY profit DESC, product_id) AS rn FROM x_cp WHERE profit > 0) WHERE rn <= 5 GROUP BY 1) USING (customer_id)
    LEFT JOIN (SELECT customer_id, string_agg(CAST(product_id AS VARCHAR), ';' ORDER BY rn) AS loss_products FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY profit, product_id) AS rn FROM x_cp WHERE profit < 0) WHERE rn <= 5 GROUP BY 1) USING (customer_id)""",
    "revenue profit overall_margin",
)
def _a51(w):
    p = ops.product_profiles(w.customer_product_month(extra=("product_line",)))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["product_id"].cast("string")), ";")
    return p.select("customer_id", "revenue", "profit", "products", "overall_margin", "main_line", ids("top_revenue").alias("top_products"), ids("top_profit").alias("best_products"), ids("top_loss").alias("loss_products"))


cte(
    "x_decl",
    f"""SELECT customer_id, product_id, recent, prior, change_pct, loss, row_number() OVER (PARTITION BY customer_id ORDER BY change_pct, product_id) AS rank FROM (SELECT *, (recent-prior)/prior*100 AS change_pct, prior-recent AS loss FROM (
      SELECT customer_id, product_id, {tot('revenue', 'r <= 3')} AS recent, {tot('revenue', 'r > 3')} AS prior FROM cpm JOIN (SELECT customer_id, month_idx, row_number() OVER (PARTITION BY customer_id ORDER BY month_idx DESC) AS r, count(*) OVER (PARTITION BY customer_id) AS n FROM cm) m USING (customer_id, month_idx)
      WHERE n >= 4 AND r <= 6 GROUP BY 1, 2) WHERE prior > 0 AND recent < prior) WHERE change_pct < -20""",
)


@query("a52_declining_products", "SELECT * FROM x_decl WHERE rank <= 5", "recent prior change_pct loss")
def _a52(w):
    return ops.declining_products(w.customer_product_month())


cte(
    "x_glory",
    f"""SELECT b.*, best_product, best_product_revenue FROM (SELECT customer_id, month AS from_month, to_month, {d('r')} AS best_revenue, {d('p')} AS best_profit, {ratio('p', 'r')}*100 AS best_margin FROM (
        SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY r DESC, month) AS rn FROM (SELECT customer_id, month, sum(revenue) OVER w AS r, sum(profit) OVER w AS p, max(month) OVER w AS to_month, count(*) OVER w AS k FROM cm
          WINDOW w AS (PARTITION BY customer_id ORDER BY month_idx ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)) WHERE k = 12 AND r > 0) WHERE rn = 1) b
      LEFT JOIN (SELECT customer_id, product_id AS best_product, {d('revenue')} AS best_product_revenue FROM {_TOP} WHERE rn = 1) USING (customer_id)""",
)


@query("a53_best_window", _A + "x_glory", "best_revenue best_profit best_margin best_product_revenue")
def _a53(w):
    return ops.best_window(w.customer_month(), w.customer_product_month())


_HI = "tier IN ('KA','AA','KM')"


@query(
    "a54_rd_recommendations",
    f"""SELECT product_id, q/6 AS monthly_qty, rev/6 AS monthly_revenue, margin, growth_yoy, high_share, hpi, high_customers, customers, cv, asp, CASE WHEN cv < 0.3 AND customers >= 5 THEN 'high' WHEN cv < 0.8 THEN 'medium' ELSE 'low' END AS rigidity,
      CASE WHEN hpi > 1.3 AND customers >= 10 AND cv < 0.8 THEN 'second_generation' WHEN rev > 500000 AND margin < 20 THEN 'cut_cost' WHEN customers >= 20 AND high_share < 30 THEN 'key_account_push' WHEN growth_yoy < -30 AND margin < 20 THEN 'replace' ELSE 'observe' END AS recommendation FROM (
      SELECT *, hr/rev*100 AS high_share, p/rev*100 AS margin, rev/q AS asp, CASE WHEN qy > 0 THEN (q-qy)/qy*100 END AS growth_yoy, CASE WHEN mean > 0 AND n > 1 THEN sd/mean ELSE 0 END AS cv, coalesce(hr/rev*100/nullif(base,0), 0) AS hpi FROM (
        SELECT product_id, {tot('revenue', win(6))} AS rev, {tot('qty', win(6))} AS q, {tot('profit', win(6))} AS p, {tot('qty', win(6, 12))} AS qy, stddev_samp({d('qty')}) FILTER (WHERE {win(6)}) AS sd, avg({d('qty')}) FILTER (WHERE {win(6)}) AS mean, {cnt(win(6))} AS n FROM pm GROUP BY 1)
      LEFT JOIN (SELECT product_id, {tot('revenue', _HI)} AS hr, count(DISTINCT customer_id) FILTER (WHERE {_HI}) AS high_customers, count(DISTINCT customer_id) AS customers FROM cpm JOIN cust USING (customer_id) WHERE {win(6)} GROUP BY 1) USING (product_id),
      (SELECT {ratio(f'sum(revenue) FILTER (WHERE {_HI})', 'sum(revenue)')}*100 AS base FROM cpm JOIN cust USING (customer_id) WHERE {win(6)}) WHERE rev > 0 AND q > 0)""",
    "monthly_qty monthly_revenue margin growth_yoy high_share hpi cv asp",
)
def _a54(w):
    return ops.rd_recommendations(w.product_month(months=18), w.customer_product_month(months=6), w.customers("tier"), w.latest)


_PR = "(CASE WHEN qty > 0 THEN price END)"
_L100 = "least(100, greatest(0, {}))".format


@query(
    "a55_category_aptitude",
    f"""WITH x AS (SELECT f.*, cust.owner FROM (SELECT customer_id, product_id, product_line, month_idx, bool_or(is_new) AS is_new, sum(qty) AS qty, sum(revenue) AS revenue, sum(profit) AS profit, {ratio('sum(revenue)', 'sum(qty)')} AS price FROM fact GROUP BY 1, 2, 3, 4) f JOIN cust ON f.customer_id = cust.customer_id),
      comp AS (SELECT product_line, sum({d('profit')})/greatest(sum({d('revenue')}), 1)*100 AS cm_, {d('sum(revenue)')} AS crev, quantile_cont({_PR}, 0.5) AS cp FROM x GROUP BY 1),
      g AS (SELECT owner, product_line, {d('sum(revenue)')} AS rev, {d('sum(profit)')} AS p, count(DISTINCT customer_id) AS customers, {tot('revenue', 'month_idx >= l - 6')} AS r6, {tot('revenue', 'month_idx < l - 6 AND month_idx >= l - 12')} AS p6, {tot('revenue', 'is_new')} AS nr, quantile_cont({_PR}, 0.5) AS op
        FROM (SELECT *, max(month_idx) OVER (PARTITION BY owner, product_line) AS l FROM x) GROUP BY 1, 2),
      cr AS (SELECT owner, product_line, count(*) AS xx FROM (SELECT owner, customer_id, product_line, count(*) OVER (PARTITION BY owner, customer_id) AS k FROM (SELECT DISTINCT owner, customer_id, product_line FROM x)) WHERE k > 1 GROUP BY 1, 2),
      s AS (SELECT *, {_L100("50 + margin_dev*0.5 + CASE WHEN crev > 0 THEN p/greatest(crev,1)*100 ELSE 0 END*2")} AS profit_score FROM (SELECT *, (margin - cm_)/greatest(abs(cm_), 1)*100 AS margin_dev, CASE WHEN p6 > 0 THEN {_L100("50 + (r6-p6)/p6*100")} ELSE 50 END AS growth_score, least(100, nr/greatest(rev,1)*100*5) AS new_score,
        {_L100("50 + coalesce(CASE WHEN cp > 0 THEN (op-cp)/greatest(cp,1)*100 END, 0)*2")} AS pricing_score, least(100, coalesce({d('xx')}, 0)/customers*100*0.8) AS cross_score FROM (SELECT *, p/greatest(rev,1)*100 AS margin FROM g JOIN comp USING (product_line) LEFT JOIN cr USING (owner, product_line))))
      SELECT owner, product_line, rev, margin, customers, profit_score, growth_score, new_score, pricing_score, cross_score, profit_score*0.3 + growth_score*0.25 + new_score*0.2 + pricing_score*0.15 + cross_score*0.1 AS composite,
        CASE WHEN margin_dev > 10 AND profit_score > 60 THEN 'profit' WHEN new_score > 60 THEN 'new_products' WHEN growth_score > 60 THEN 'growth' ELSE 'traffic' END AS aptitude, least(95, greatest(30, customers*5 + 30)) AS confidence,
        CASE WHEN growth_score > 65 THEN 'rising' WHEN growth_score > 45 THEN 'stable' ELSE 'falling' END AS trend FROM s""",
    "rev margin profit_score growth_score new_score pricing_score cross_score composite",
)
def _a55(w):
    return ops.category_aptitude(w.customer_product_month(extra=("product_line", "is_new")), w.customers("owner"))


_LOG = "log10(greatest(CAST({} AS DOUBLE), 1))"
_SHARE = "({}/greatest(CAST({} AS DOUBLE), 1)*100)"


def _cap(x):
    return f"least(greatest(CAST({x} AS DOUBLE), 0), 100)"


def _sh(a, b="n"):
    return _SHARE.format(a, b)


_CAPABILITY = {
    "absolute": f"50 + CASE WHEN rev > 0 THEN (least(greatest({_LOG.format('rev')}*20, 20), 100) - 50)*0.5 ELSE 0 END + CASE WHEN prof > 0 THEN (least(greatest(log10(greatest(prof, 0) + 1)*20, 20), 100) - 50)*0.3 ELSE 0 END + coalesce(least(greatest(mg*100, -20), 50)*0.2, 0)",
    "retention": f"50 + ({_sh('act')} - 40)*0.4 + least(0*0.3, 20)",
    "category": f"50 + ({_sh('multi')} - 30)*0.3 + least({_LOG.format('multi')}*20, 30) + least({_sh('has_new')}, 30)*0.3 + least(coalesce(avg_new, 0)*1.5, 15)",
    "pricing": f"50 + (100 - least({_sh('neg')}*2, 100))*0.2 + CASE WHEN nk > 0 THEN ({_sh('nk_high', 'nk')} - 30)*0.25 + least({_LOG.format('nk_high')}*15, 25) ELSE 0 END - least(coalesce(low, 0), 50)*0.2",
    "acquisition": f"50 + {_sh('fresh')}*0.5 + (re1*0.5 + re2*0.3 + re3*1.0)/n*100*0.5 + CASE WHEN fresh > 0 THEN ({_sh('fresh_good', 'fresh')} - 40)*0.2 ELSE 0 END",
    "activation": "50",
    "upgrade": f"50 + CASE WHEN nk > 0 THEN least(nk_sa*2.5, 50) + greatest({_sh('nk_sa', 'nk')} - 15, 0) ELSE 0 END",
    "mix": f"50 + least({_LOG.format('high')}*30, 40) + coalesce(least(greatest((mm - 15)*0.5, 0), 20), 0)",
    "diversification": "CASE WHEN rev > 0 THEN (1 - hhi)*100 ELSE 50 END",
}
_KEYS = "tier IN ('KA', 'AA')"
_RE = "journey = 'reactivated' AND days_since"
cte("x_own", f"""SELECT owner, count(*) AS n, sum(revenue_12m) AS rev, sum(profit_12m) AS prof, {cnt('revenue_12m > 0')} AS act, {cnt(_KEYS)} AS key_customers, {cnt(f'NOT {_KEYS}')} AS nk, {cnt(f"NOT {_KEYS} AND profit_level = 'high'")} AS nk_high, {cnt("profit_level = 'high'")} AS high, {cnt('loss_products > 0')} AS neg, avg(low_share) AS low,
  {cnt("lifecycle IN ('intro', 'ramp')")} AS fresh, {cnt("lifecycle IN ('intro', 'ramp') AND value_tier IN ('S', 'A', 'B')")} AS fresh_good, {cnt(f'{_RE} BETWEEN 1 AND 365')} AS re1, {cnt(f'{_RE} BETWEEN 366 AND 730')} AS re2, {cnt(f'{_RE} > 730')} AS re3, {cnt('categories >= 3')} AS multi, {cnt('new_share > 0')} AS has_new, avg(new_share) AS avg_new,
  {cnt(f"NOT {_KEYS} AND value_tier IN ('S', 'A')")} AS nk_sa, sum(CASE WHEN orv > 0 THEN power(revenue_12m/orv, 2) END) AS hhi, quantile_cont(growth, 0.5) AS mg, quantile_cont(CAST(margin_12m AS DOUBLE), 0.5) AS mm
  FROM (SELECT sp.*, loss_products, sum(revenue_12m) OVER (PARTITION BY owner) AS orv FROM sp LEFT JOIN x_neg USING (customer_id)) WHERE owner IS NOT NULL AND owner <> 'unknown' GROUP BY 1""")
cte("x_prof", f"SELECT *, {' + '.join(f'{k}*{v}' for k, v in ops.PROFILE_WEIGHTS.items())} AS composite FROM (SELECT owner, n AS customers, rev, key_customers, CASE WHEN rev > 10000000 THEN 'heavy' WHEN rev > 1000000 THEN 'middle' ELSE 'light' END AS revenue_class, CASE WHEN n > 150 THEN 'batch' WHEN n > 50 THEN 'balanced' ELSE 'key_customer' END AS subgroup, {', '.join(f'{_cap(x)} AS {k}' for k, x in _CAPABILITY.items())} FROM x_own)")
_PROF = "rev composite " + " ".join(ops.PROFILE_WEIGHTS)


def _profile(w):
    s = w.stored
    return ops.sales_profile(s.scored_portrait(), ops.negative_margin(s.customer_product_month()))


query("a56_sales_profile", """SELECT * EXCLUDE (k, r), CASE WHEN rev > 80000000 THEN 'A' WHEN rev <= 0 THEN 'D' WHEN k < 2 THEN 'B' WHEN r >= 70 THEN 'A' WHEN r >= 40 THEN 'B' WHEN r < 25 THEN 'D' ELSE 'C' END AS grade FROM (
  SELECT *, count(*) OVER g AS k, (rank() OVER (g ORDER BY composite) + (count(*) OVER (PARTITION BY revenue_class, subgroup, composite) - 1)/2.0)/count(*) OVER g*100 AS r FROM x_prof WINDOW g AS (PARTITION BY revenue_class, subgroup))""", _PROF)(_profile)
cte("x_cap", f"UNPIVOT (SELECT owner, {', '.join(ops.PROFILE_WEIGHTS)} FROM x_prof) ON {', '.join(ops.PROFILE_WEIGHTS)} INTO NAME capability VALUE score")
query("a57_capability_scores", "SELECT owner, capability, score, score - avg(score) OVER (PARTITION BY capability) AS gap FROM x_cap", "score gap")(lambda w: ops.capability_scores(_profile(w)))


_RULES = """WITH p AS (SELECT DISTINCT order_id AS b, product_line AS i FROM fact), q AS (SELECT * FROM p WHERE b IN (SELECT b FROM p GROUP BY 1 HAVING count(*) >= 2)), t AS (SELECT CAST(count(DISTINCT b) AS DOUBLE) AS t FROM q),
  c AS (SELECT i, count(*) AS n FROM q GROUP BY 1), pr AS (SELECT x.i AS a, y.i AS b, count(*) AS n FROM q x JOIN q y ON x.b = y.b AND x.i <> y.i GROUP BY 1, 2)
  SELECT a AS item, pr.b AS with_item, pr.n/t AS support, CAST(pr.n AS DOUBLE)/ca.n AS confidence, (CAST(pr.n AS DOUBLE)/ca.n)/(cb.n/t) AS lift, pr.n/t - (ca.n/t)*(cb.n/t) AS leverage,
    CASE WHEN pr.n < ca.n THEN (1 - cb.n/t)/(1 - CAST(pr.n AS DOUBLE)/ca.n) END AS conviction, pr.n AS baskets FROM pr JOIN c ca ON ca.i = a JOIN c cb ON cb.i = pr.b, t WHERE pr.n >= 0.02*t AND CAST(pr.n AS DOUBLE)/ca.n >= 0.15"""
cte("x_rules", _RULES)
_RD = "support confidence lift leverage conviction"


@query("a58_association_rules", _A + "x_rules", _RD)
def _a58(w):
    return ops.association_rules(w.fact("order_id", "product_line"), ["order_id"], "product_line")


cte("x_month_rules", """WITH p AS (SELECT DISTINCT customer_id, month_idx, product_id AS i FROM fact), q AS (SELECT customer_id, month_idx, i FROM (SELECT *, count(*) OVER (PARTITION BY customer_id, month_idx) AS k FROM p) WHERE k >= 2), t AS (SELECT CAST(count(DISTINCT (customer_id, month_idx)) AS DOUBLE) AS t FROM q),
  c AS (SELECT i, count(*) AS n FROM q GROUP BY 1), pr AS (SELECT x.i AS a, y.i AS b, count(*) AS n FROM q x JOIN q y ON x.customer_id = y.customer_id AND x.month_idx = y.month_idx AND x.i <> y.i GROUP BY 1, 2)
  SELECT a AS item, pr.b AS with_item, pr.n/t AS support, CAST(pr.n AS DOUBLE)/ca.n AS confidence, (CAST(pr.n AS DOUBLE)/ca.n)/(cb.n/t) AS lift, pr.n/t - (ca.n/t)*(cb.n/t) AS leverage,
    CASE WHEN pr.n < ca.n THEN (1 - cb.n/t)/(1 - CAST(pr.n AS DOUBLE)/ca.n) END AS conviction, pr.n AS baskets FROM pr JOIN c ca ON ca.i = a JOIN c cb ON cb.i = pr.b, t WHERE pr.n >= 0.00015*t AND CAST(pr.n AS DOUBLE)/ca.n >= 0.01""")


@query("a58_month_basket_rules", "SELECT * FROM x_month_rules", _RD)
def _a58m(w):
    return ops.association_rules(w.fact("customer_id", "month_idx", "product_id"), ["customer_id", "month_idx"], "product_id", min_support=0.00015, min_confidence=0.01)


@query("a66_gated_association", "SELECT * FROM x_month_rules WHERE (SELECT count(*) FROM cpm) >= 100", _RD)
def _a66(w):
    return ops.gated_association(w.customer_product_month().select("customer_id", "month_idx", "product_id"), ["customer_id", "month_idx"], "product_id", min_support=0.00015, min_confidence=0.01)


@query("a64_association_bonus", "SELECT item, with_item, confidence, confidence*5 AS bonus FROM x_rules", "confidence bonus")
def _a64(w):
    return ops.association_bonus(ops.association_rules(w.fact("order_id", "product_line"), ["order_id"], "product_line"))


_BON = " ".join(f"WHEN '{k}' THEN {v}" for k, v in ops.PORTRAIT_BONUS.items())
cte(
    "x_score",
    f"""SELECT *, popularity*10 + (CASE portrait {_BON} ELSE 0 END) + CASE WHEN dead_stock THEN 3 ELSE 0 END AS score FROM (SELECT product_id, buyers, {d('buyers')}/max(buyers) OVER () AS popularity, portrait, coalesce(over_1y_share > 0.15 AND over_1y > 0, FALSE) AS dead_stock
      FROM (SELECT product_id, count(DISTINCT customer_id) AS buyers FROM cpm GROUP BY 1) LEFT JOIN (SELECT product_id, portrait FROM pp WHERE as_of = {LM}) USING (product_id) LEFT JOIN x_aging USING (product_id))""",
)


@query("a60_recommendation_scores", _A + "x_score", "popularity score")
def _a60(w):
    s = w.stored
    return ops.recommendation_scores(s.customer_product_month(), w.product_portrait(), ops.estimate_aging(s.product_month(), w.latest))


_PRULES = """SELECT x.i AS a, y.i AS b, count(*) AS n FROM q x JOIN q y ON x.b = y.b AND x.i <> y.i GROUP BY 1, 2"""


@query(
    "a59_cross_sell",
    """WITH p AS (SELECT DISTINCT order_id AS b, product_id AS i FROM fact), q AS (SELECT * FROM p WHERE b IN (SELECT b FROM p GROUP BY 1 HAVING count(*) >= 2)), t AS (SELECT count(DISTINCT b) AS t FROM q), c AS (SELECT i, count(*) AS n FROM q GROUP BY 1),
      pr AS (SELECT a, b, CAST(n AS DOUBLE)/cn*5 AS bonus FROM (SELECT x.i AS a, y.i AS b, count(*) AS n, any_value(c.n) AS cn FROM q x JOIN q y ON x.b = y.b AND x.i <> y.i JOIN c ON c.i = x.i GROUP BY 1, 2), t WHERE n >= 0.0003*t AND CAST(n AS DOUBLE)/cn >= 0.02),
      bought AS (SELECT DISTINCT customer_id, product_id, product_line AS grp FROM cpm), lk AS (SELECT customer_id, b AS product_id, sum(bonus) AS bonus FROM bought JOIN pr ON product_id = a GROUP BY 1, 2),
      cand AS (SELECT cu.customer_id, s.product_id, dead_stock, portrait, pl.grp, s.score + CASE WHEN ln.grp IS NOT NULL THEN 3 ELSE 0 END + coalesce(bonus, 0) AS score, ln.grp IS NOT NULL AS same, bonus
        FROM (SELECT DISTINCT customer_id FROM bought) cu CROSS JOIN x_score s JOIN (SELECT DISTINCT product_id, product_line AS grp FROM cpm) pl ON pl.product_id = s.product_id
        LEFT JOIN (SELECT DISTINCT customer_id, grp FROM bought) ln ON ln.customer_id = cu.customer_id AND ln.grp = pl.grp LEFT JOIN lk ON lk.customer_id = cu.customer_id AND lk.product_id = s.product_id
        LEFT JOIN bought bo ON bo.customer_id = cu.customer_id AND bo.product_id = s.product_id WHERE bo.product_id IS NULL)
      SELECT customer_id, rank, product_id, dead_stock, score, concat_ws('; ', CASE WHEN same THEN 'same line ' || grp END, CASE WHEN bonus IS NOT NULL THEN 'bought together' END, CASE WHEN NOT same AND bonus IS NULL THEN coalesce('portrait ' || portrait, 'popular') END) AS reason
      FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY dead_stock DESC, score DESC, product_id) AS rank FROM cand) WHERE rank <= 5""",
    "score",
)
def _a59(w):
    s = w.stored
    scores = ops.recommendation_scores(s.customer_product_month(), w.product_portrait(), ops.estimate_aging(s.product_month(), w.latest))
    rules = ops.association_rules(w.fact("order_id", "product_id"), ["order_id"], "product_id", min_support=0.0003, min_confidence=0.02)
    return ops.cross_sell(s.customer_product_month(), settle_scores(scores), rules)


def settle_scores(df):
    from ..functions.settle import settle

    return settle(df)


def _bridge(net: bool) -> str:
    f = "" if net else "AND qty > 0"
    sums = ", ".join(f"{tot(m, win(12, 12 * (1 - n)))} AS {m}_{n}" for n in (1, 0) for m in ("qty", "revenue", "cost", "profit"))
    return f"""SELECT comparable_products, profit_before, profit_now, (q1-q0)*m0/nullif(q0,0) AS volume_effect, price_effect, cost_effect, m1-m0-(q1-q0)*m0/nullif(q0,0)-price_effect-cost_effect AS mix_effect, profit_now-profit_before-(m1-m0) AS other_products FROM (
      SELECT {cnt('ok')} AS comparable_products, sum(profit_0) AS profit_before, sum(profit_1) AS profit_now, sum(qty_1) FILTER (WHERE ok) AS q1, sum(qty_0) FILTER (WHERE ok) AS q0, sum(profit_0) FILTER (WHERE ok) AS m0, sum(profit_1) FILTER (WHERE ok) AS m1,
        sum((revenue_1/qty_1 - revenue_0/qty_0)*qty_1) FILTER (WHERE ok) AS price_effect, sum((cost_0/qty_0 - cost_1/qty_1)*qty_1) FILTER (WHERE ok) AS cost_effect
      FROM (SELECT *, qty_1 > 0 AND qty_0 > 0 AND revenue_1 > 0 AND revenue_0 > 0 AS ok FROM (SELECT product_id, {sums} FROM fact WHERE {win(24)} {f} GROUP BY 1)))"""


_BD = "profit_before profit_now volume_effect price_effect cost_effect mix_effect other_products"
_BC = ("product_id", "month_idx", "qty", "revenue", "cost", "profit")
query("a61_profit_bridge", _bridge(False), _BD)(lambda w: ops.profit_bridge(w.fact(*_BC, months=24), w.latest))
query("a62_net_profit_bridge", _bridge(True), _BD)(lambda w: ops.profit_bridge(w.fact(*_BC, months=24), w.latest, net=True))


@query(
    "a63_owner_sku_mix",
    f"""SELECT owner, {d('sum(r)')} AS revenue, {", ".join(f"{tot('r', f'cls = {x!r}')} AS {x}_revenue, {cnt(f'cls = {x!r}')} AS {x}_products" for x in ('star', 'regular', 'hook'))} FROM (
      SELECT *, CASE WHEN m > c + 0.05 THEN 'star' WHEN m < c - 0.05 THEN 'hook' ELSE 'regular' END AS cls FROM (SELECT owner, product_id, sum(revenue) AS r, {ratio('sum(profit)', 'sum(revenue)')} AS m FROM fact WHERE {win(12)} GROUP BY 1, 2),
      (SELECT {ratio('sum(profit)', 'sum(revenue)')} AS c FROM fact WHERE {win(12)})) GROUP BY 1""",
    "revenue star_revenue regular_revenue hook_revenue",
)
def _a63(w):
    return ops.owner_sku_mix(w.fact("owner", "product_id", "month_idx", "revenue", "profit", months=12), w.latest)


@query(
    "a67_margin_structure",
    f"""SELECT customer_id, CASE WHEN tr > 0 THEN t5/{d('tr')}*100 ELSE 0 END AS top5_pct, om AS overall_margin, pmg AS peer_margin, CASE WHEN pmg IS NULL THEN 'unknown' WHEN om > pmg*1.1 THEN 'above' WHEN om < pmg*0.9 THEN 'below' ELSE 'equal' END AS versus_peers, drain_product, star_product
    FROM x_cpt JOIN (SELECT customer_id, {d('sum(revenue) FILTER (WHERE rn <= 5)')} AS t5 FROM {_TOP} GROUP BY 1) USING (customer_id)
    LEFT JOIN (SELECT customer_id, product_id AS drain_product FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY profit, product_id) AS rn FROM x_cp WHERE profit < 0) WHERE rn = 1) USING (customer_id)
    LEFT JOIN (SELECT customer_id, product_id AS star_product FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY profit DESC, product_id) AS rn FROM x_cp WHERE profit > 0) WHERE rn = 1) USING (customer_id),
    (SELECT quantile_cont(om, 0.5) AS pmg FROM x_cpt JOIN sp USING (customer_id) WHERE value_tier IN ('S','A'))""",
    "top5_pct overall_margin peer_margin",
)
def _a67(w):
    s = w.stored
    return ops.margin_structure(ops.product_profiles(s.customer_product_month()), s.scored_portrait())


@query(
    "a68_drain_and_star",
    f"""SELECT customer_id, max(product_id) FILTER (WHERE drag > 0 AND dr = 1) AS drain_product, max(CASE WHEN drag > 0 THEN drag END) AS drag_pp, max(product_id) FILTER (WHERE gain > 0 AND gr = 1) AS star_product, max(CASE WHEN gain > 0 THEN gain END) AS star_profit,
      {cnt("lab = 'drain'")} AS drain_products, {cnt("lab = 'star'")} AS star_products, {cnt("lab = 'volume'")} AS volume_products FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY drag DESC NULLS LAST, product_id) AS dr, row_number() OVER (PARTITION BY customer_id ORDER BY gain DESC NULLS LAST, product_id) AS gr FROM (
        SELECT customer_id, product_id, CASE WHEN margin < om AND tr > 0 THEN (om-margin)*{d('revenue')}/{d('tr')} END AS drag, CASE WHEN margin > om THEN {d('revenue')}*margin/100 END AS gain,
          CASE WHEN margin < 0 THEN 'drain' WHEN margin > om*1.3 THEN 'star' WHEN revenue > 0 AND margin > 0 THEN 'volume' ELSE 'ordinary' END AS lab FROM {_TOP} JOIN x_cpt USING (customer_id) WHERE rn <= 5)) GROUP BY 1""",
    "drag_pp star_profit",
)
def _a68(w):
    return ops.drain_and_star(ops.product_profiles(w.customer_product_month(extra=("product_line",))))


@query("a69_product_labels", f"SELECT customer_id, product_id, margin, CASE WHEN margin < 0 THEN 'drain' WHEN margin > om*1.3 THEN 'star' WHEN revenue > 0 AND margin > 0 THEN 'volume' ELSE 'ordinary' END AS label FROM x_cp JOIN x_cpt USING (customer_id)", "margin")
def _a69(w):
    cp = ops.customer_products(w.customer_product_month())
    t = cp.groupBy("customer_id").agg(F.sum("revenue").alias("tr"), F.sum("profit").alias("tp"))
    om = F.when(F.col("tr") > 0, F.col("tp").cast("double") / F.nullif(F.col("tr").cast("double"), F.lit(0.0)) * 100).otherwise(0.0)
    return cp.join(t, "customer_id").select("customer_id", "product_id", "margin", ops.product_label(F.col("revenue"), F.col("margin"), om).alias("label"))
