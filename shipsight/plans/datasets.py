"""Presentation datasets."""

from pyspark.sql import functions as F

from ..operators import datasets as ops
from ..operators import insights
from .registry import cte, query
from .sqlbits import LM, cnt, d, ratio, tot, win

cte("pr", "SELECT m AS latest, CAST((m-1)//12 AS INT) AS y, CAST((m-1)%12+1 AS INT) AS mo, CAST(((m-1)//12)*12 + CASE WHEN (m-1)%12+1 <= 7 THEN 1 ELSE 7 END AS INT) AS hs FROM lm")
Y, HS = "(SELECT y FROM pr)", "(SELECT hs FROM pr)"


def ytd(back: int = 0) -> str:
    return f"(month_idx > {Y}*12 - {12 * back} AND month_idx <= {LM} - {12 * back})"


def half(back: int = 0) -> str:
    return f"(month_idx >= {HS} - {6 * back} AND month_idx <= {HS} - {6 * back} + 5)"


def mo(back: int) -> str:
    return f"(month_idx = {LM} - {back})"


def mg(p: str, r: str) -> str:
    return f"(CASE WHEN {r} > 0 THEN {p}/{r}*100 ELSE 0 END)"


def gr(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN ({a}-{b})/{b}*100 END)"


def sums(cond: str, suffix: str, ms=("revenue", "profit", "qty")) -> str:
    return ", ".join(f"{tot(m, cond)} AS {m}_{suffix}" for m in ms)


KEY = "tier IN ('KA','AA')"
P = lambda w: ops.Periods(w.latest)
BULK = 45.0


@query(
    "b01_periods",
    """SELECT latest, y AS year, mo AS month, latest-1 AS previous, y*12+1 AS ytd_from, y*12-11 AS prior_ytd_from, latest-12 AS prior_ytd_to, latest-11 AS last12_from, latest-5 AS near6_from, latest-11 AS prev6_from, latest-6 AS prev6_to,
    hs AS half_from, hs+5 AS half_to, hs-6 AS prev_half_from, hs-12 AS half_last_year_from FROM pr""",
)
def _b01(w):
    # The latest month comes from the fact, the rest is arithmetic on it.
    return w.fact("month_idx").agg(F.max("month_idx").alias("m")).select(*[
        (F.lit(v) if k != "latest" else F.col("m")).cast("int").alias(k) for k, v in ops.periods_table(w.spark, P(w)).first().asDict().items()
    ])


@query("b02_half_windows", f"SELECT CASE WHEN {half()} THEN 'current' WHEN {half(1)} THEN 'previous_half' ELSE 'same_half_last_year' END AS window_tag, count(*) AS rows, min(month_idx) AS from_idx, max(month_idx) AS to_idx FROM fact WHERE {half()} OR {half(1)} OR {half(2)} GROUP BY 1")
def _b02(w):
    return ops.half_tags(w.fact("month_idx"), P(w)).groupBy("window_tag").agg(F.count("*").alias("rows"), F.min("month_idx").alias("from_idx"), F.max("month_idx").alias("to_idx"))


@query(
    "b03_ytd_kpi",
    f"""SELECT revenue_ytd, profit_ytd, cost_ytd, {mg('profit_ytd', 'revenue_ytd')} AS margin, {gr('revenue_ytd', 'revenue_py')} AS revenue_yoy, {gr('profit_ytd', 'profit_py')} AS profit_yoy, kr/nullif(revenue_ytd,0)*100 AS key_share, key_customers,
      revenue_ytd/nullif(qty_ytd,0) AS asp, (revenue_ytd/qty_ytd - revenue_py/qty_py)/(revenue_py/qty_py)*100 AS asp_yoy, (revenue_m0/qty_m0 - revenue_m1/qty_m1)/(revenue_m1/qty_m1)*100 AS asp_mom FROM (
      SELECT {sums(ytd(), 'ytd', ('revenue', 'profit', 'qty', 'cost'))}, {sums(ytd(1), 'py')}, {tot('revenue', f'{ytd()} AND {KEY}')} AS kr, count(DISTINCT customer_id) FILTER (WHERE {ytd()} AND {KEY}) AS key_customers, {sums(mo(0), 'm0')}, {sums(mo(1), 'm1')} FROM fact)""",
    "revenue_ytd profit_ytd cost_ytd margin revenue_yoy profit_yoy key_share asp asp_yoy asp_mom",
)
def _b03(w):
    return ops.ytd_kpi(w.fact("customer_id", "tier", "month_idx", *w.MONEY, months=24), P(w))


_SLOT = ", ".join(f"CAST(sum({m}) FILTER (WHERE (month_idx-1)%12+1 = {i}) AS DOUBLE) AS {m}_{i:02d}" for m in ("revenue", "profit") for i in range(1, 13))
_SD = " ".join(f"{m}_{i:02d}" for m in ("revenue", "profit") for i in range(1, 13))
query("b04_monthly_trend", f"SELECT CAST((month_idx-1)//12 AS INT) AS year, {_SLOT} FROM fact WHERE month_idx > ({Y}-2)*12 GROUP BY 1", _SD)(lambda w: ops.monthly_slots(w.fact("month_idx", "revenue", "profit", months=36), P(w)))
query("b05_tier_trend", f"SELECT tier, CAST((month_idx-1)//12 AS INT) AS year, {_SLOT} FROM fact WHERE month_idx > ({Y}-2)*12 GROUP BY 1, 2", _SD)(lambda w: ops.monthly_slots(w.fact("tier", "month_idx", "revenue", "profit", months=36), P(w), ["tier"]))
query("b06_tier_customers", f"SELECT tier, count(DISTINCT customer_id) AS customers FROM fact WHERE {ytd()} GROUP BY 1")(lambda w: ops.tier_customers(w.fact("tier", "customer_id", "month_idx", months=12), P(w)))


@query("b07_key_account_scatter", f"""SELECT * FROM (SELECT customer_id, tier, revenue_ytd, {mg('profit_ytd', 'revenue_ytd')} AS margin, {gr('revenue_ytd', 'revenue_py')} AS growth FROM (SELECT customer_id, tier, {sums(ytd(), 'ytd')}, {sums(ytd(1), 'py')} FROM fact WHERE {KEY} GROUP BY 1, 2)) WHERE revenue_ytd > 0 AND abs(growth) < 500""", "revenue_ytd margin growth")
def _b07(w):
    return ops.key_account_scatter(w.fact("customer_id", "tier", "month_idx", "revenue", "profit", months=24), P(w))


@query("b08_key_account_list", f"""SELECT customer_id, tier, owner, revenue_ytd, profit_ytd, {mg('profit_ytd', 'revenue_ytd')} AS margin, {gr('revenue_ytd', 'revenue_py')} AS yoy, {gr('revenue_m0', 'revenue_m1')} AS mom, revenue_ytd/nullif(qty_ytd,0) AS asp FROM cust JOIN (
  SELECT customer_id, {sums(ytd(), 'ytd')}, {sums(ytd(1), 'py')}, {sums(mo(0), 'm0')}, {sums(mo(1), 'm1')} FROM fact WHERE {win(24)} GROUP BY 1) USING (customer_id) WHERE {KEY}""", "revenue_ytd profit_ytd margin yoy mom asp")
def _b08(w):
    return ops.key_account_list(w.fact("customer_id", "month_idx", *ops.M3, months=24), w.customers("tier", "owner"), P(w))


@query("b09_newest_months", f"SELECT customer_id, string_agg(CAST(month_idx AS VARCHAR), ';' ORDER BY month_idx) AS months, {d('sum(revenue)')} AS revenue FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY month_idx DESC) AS rn FROM cm) WHERE rn <= 12 GROUP BY 1", "revenue")
def _b09(w):
    s = ops.newest_months(w.customer_month())
    return s.select("customer_id", F.array_join(F.transform("series", lambda x: x["month_idx"].cast("string")), ";").alias("months"), F.aggregate("series", F.lit(0.0), lambda a, x: a + x["revenue"]).alias("revenue"))


_BL = (("ytd", ytd()), ("prior_ytd", ytd(1)), ("latest", mo(0)), ("prev", mo(1)), ("l12", win(12)))
_MB = ", ".join(f"{mg(f'profit_{n}', f'revenue_{n}')} AS margin_{n}" for n, _ in _BL)
query("b10_financial_blocks", f"SELECT *, {_MB} FROM (SELECT customer_id, {', '.join(sums(c, n, ('revenue', 'profit')) for n, c in _BL)} FROM cm GROUP BY 1)", " ".join(f"{m}_{n}" for m in ("revenue", "profit", "margin") for n, _ in _BL))(lambda w: ops.financial_blocks(w.customer_month(), P(w)))


@query("b11_channel_view", f"""SELECT CASE WHEN g = 7 THEN 'channel' WHEN g = 3 THEN 'agent' WHEN g = 1 THEN 'agent_customer' ELSE 'month' END AS level, channel, agent, customer_id, month_idx, revenue, profit, qty, rows, {mg('profit', 'revenue')} AS margin FROM (
  SELECT channel, owner AS agent, customer_id, month_idx, grouping(channel, owner, customer_id, month_idx) AS g, {d('sum(revenue)')} AS revenue, {d('sum(profit)')} AS profit, {d('sum(qty)')} AS qty, count(*) AS rows FROM fact WHERE {win(12)}
  GROUP BY GROUPING SETS ((channel), (channel, owner), (channel, owner, customer_id), (channel, month_idx)))""", "revenue profit qty margin")
def _b11(w):
    return ops.channel_view(w.fact("channel", "owner", "customer_id", "month_idx", *ops.M3, months=12).withColumnRenamed("owner", "agent"), P(w))


@query("b12_pair_cells", f"""WITH t AS (SELECT customer_id, product_id, month_idx, revenue, profit, qty, max(revenue) OVER (PARTITION BY customer_id, product_id ORDER BY month_idx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS r1, max(revenue) OVER (PARTITION BY customer_id, product_id ORDER BY month_idx RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING) AS r12 FROM cpm),
  rf AS (SELECT customer_id, product_id, month_idx AS ref_idx, ({d('revenue')}-{d('r1')})/nullif({d('r1')},0)*100 AS mom, ({d('revenue')}-{d('r12')})/nullif({d('r12')},0)*100 AS yoy FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, product_id ORDER BY month_idx DESC) AS rn FROM t WHERE revenue <> 0) WHERE rn = 1)
  SELECT customer_id, product_id, month_idx, {d('revenue')} AS revenue, {d('profit')} AS profit, {d('qty')} AS qty, ref_idx, mom, yoy FROM t LEFT JOIN rf USING (customer_id, product_id) WHERE {win(12)}""", "revenue profit qty mom yoy")
def _b12(w):
    return ops.pair_cells(w.customer_product_month(), P(w))


@query("b13_product_switch", f"""WITH b AS (SELECT customer_id, product_id, sum(revenue) AS revenue, sum(profit) AS profit FROM cpm JOIN cust USING (customer_id) WHERE {KEY} AND NOT {win(12)} AND qty >= {BULK} GROUP BY 1, 2), n AS (SELECT customer_id, product_id, sum(revenue) AS revenue, sum(profit) AS profit FROM cpm JOIN cust USING (customer_id) WHERE {KEY} AND {win(12)} GROUP BY 1, 2 HAVING sum(qty) >= {BULK})
  SELECT customer_id, 'lost' AS change, product_id, {d('revenue')} AS revenue, {d('profit')} AS profit FROM b ANTI JOIN n USING (customer_id, product_id) UNION ALL SELECT customer_id, 'gained', product_id, {d('revenue')}, {d('profit')} FROM n ANTI JOIN b USING (customer_id, product_id)""", "revenue profit")
def _b13(w):
    return ops.product_switch(w.customer_product_month(), w.customers("tier"), P(w), bulk=BULK)


@query("b14_true_new_products", f"""SELECT customer_id, product_id, min(ship_date) AS first_date, {d('sum(revenue)')} AS revenue, {d('sum(qty)')} AS qty FROM fact WHERE is_new AND month_idx > {Y}*12 AND product_id IN (SELECT product_id FROM fact GROUP BY 1 HAVING min(month_idx) >= {LM} - 80) GROUP BY 1, 2 HAVING sum(qty) >= 40""", "revenue qty")
def _b14(w):
    return ops.true_new_products(w.fact("customer_id", "product_id", "is_new", "ship_date", "month_idx", "revenue", "qty"), P(w), bulk=40, months=80)


query("b15_new_revenue_share", f"SELECT *, new_revenue/revenue*100 AS new_share FROM (SELECT {d('sum(revenue)')} AS revenue, {tot('revenue', 'is_new')} AS new_revenue FROM fact WHERE {ytd()})", "revenue new_revenue new_share")(lambda w: ops.new_revenue_share(w.fact("is_new", "month_idx", "revenue", months=12), P(w)))


@query("b16_owner_ytd", f"""SELECT owner, revenue_ytd, profit_ytd, qty_ytd, orders, customers, lines, {gr('revenue_ytd', 'revenue_py')} AS yoy, {gr('revenue_m0', 'revenue_m1')} AS mom FROM (SELECT owner, {sums(ytd(), 'ytd')}, count(DISTINCT order_id) FILTER (WHERE {ytd()}) AS orders,
  count(DISTINCT customer_id) FILTER (WHERE {ytd()}) AS customers, count(DISTINCT product_line) FILTER (WHERE {ytd()}) AS lines, {sums(ytd(1), 'py')}, {sums(mo(0), 'm0')}, {sums(mo(1), 'm1')} FROM fact WHERE {win(24)} GROUP BY 1)""", "revenue_ytd profit_ytd qty_ytd yoy mom")
def _b16(w):
    return ops.owner_ytd(w.fact("owner", "order_id", "customer_id", "product_line", "month_idx", *ops.M3, months=24), P(w))


def _og(group: str, k: int) -> str:
    return f"SELECT owner, {group}, rank, {d('v')} AS revenue, {ratio('v', 't')}*100 AS share FROM (SELECT owner, {group}, v, sum(v) OVER (PARTITION BY owner) AS t, row_number() OVER (PARTITION BY owner ORDER BY v DESC, {group}) AS rank FROM (SELECT owner, {group}, sum(revenue) AS v FROM fact WHERE {ytd()} GROUP BY 1, 2)) WHERE rank <= {k}"


query("b17_owner_categories", _og("category", 8), "revenue share")(lambda w: ops.owner_top_groups(w.fact("owner", "category", "month_idx", "revenue", months=12), P(w), "category", 8))
query("b17_owner_lines", _og("product_line", 2), "revenue share")(lambda w: ops.owner_top_groups(w.fact("owner", "product_line", "month_idx", "revenue", months=12), P(w), "product_line", 2))

_FC = f"SELECT customer_id, avg({d('revenue')}) AS forecast, CASE WHEN avg({d('revenue')}) > 1.05*{d('max(l)')} THEN 'up' WHEN avg({d('revenue')}) < 0.95*{d('max(l)')} THEN 'down' ELSE 'flat' END AS direction FROM (SELECT *, CASE WHEN rn = 1 THEN revenue END AS l FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY month_idx DESC) AS rn FROM cm) WHERE rn <= 3) GROUP BY 1"


@query("b18_owner_forecast", f"SELECT owner, {cnt(chr(39).join(['direction = ', 'up', '']))} AS up, {cnt(chr(39).join(['direction = ', 'down', '']))} AS down, {cnt(chr(39).join(['direction = ', 'flat', '']))} AS flat, sum(forecast) AS forecast, count(*) AS customers FROM ({_FC}) JOIN (SELECT DISTINCT customer_id, owner FROM fact) USING (customer_id) GROUP BY 1", "forecast")
def _b18(w):
    from ..functions.core import dbl, top_k

    t = top_k(w.customer_month(), ["customer_id"], [F.desc("month_idx")], 3)
    f = t.groupBy("customer_id").agg(F.avg(dbl("revenue")).alias("forecast"), F.max(F.when(F.col("rank") == 1, dbl("revenue"))).alias("l"))
    direction = F.when(F.col("forecast") > 1.05 * F.col("l"), "up").when(F.col("forecast") < 0.95 * F.col("l"), "down").otherwise("flat")
    return ops.owner_forecast_rollup(f.withColumn("direction", direction), ops.customer_owners(w.fact("customer_id", "owner")))


query("j15_customer_owners", "SELECT DISTINCT customer_id, owner FROM fact")(lambda w: ops.customer_owners(w.fact("customer_id", "owner")))


@query("b19_owner_diagnosis", "SELECT * FROM (SELECT owner, capability, score, team_mean, score - team_mean AS gap, CAST(row_number() OVER (PARTITION BY owner ORDER BY score - team_mean, capability) AS INT) AS rank FROM (SELECT *, avg(score) OVER (PARTITION BY capability) AS team_mean FROM x_cap)) WHERE rank <= 2", "score team_mean gap")
def _b19(w):
    s = w.stored
    return ops.owner_diagnosis(insights.sales_profile(s.scored_portrait(), insights.negative_margin(s.customer_product_month())))


_SIX = "SELECT {k}, {a} AS revenue_now, {b} AS revenue_before FROM fact WHERE {w} GROUP BY {g}"
_S1 = _SIX.format(k="customer_id", a=tot("revenue", win(6)), b=tot("revenue", win(6, 6)), w=win(12), g="1")
_S2 = _SIX.format(k="customer_id, product_id", a=tot("revenue", win(6)), b=tot("revenue", win(6, 6)), w=win(12), g="1, 2")


@query("b20_customer_declines", f"""SELECT a.*, {gr('revenue_now', 'revenue_before')} AS change_pct, declining_products FROM ({_S1}) a LEFT JOIN (SELECT customer_id, string_agg(CAST(product_id AS VARCHAR), ';' ORDER BY rn) AS declining_products FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY revenue_before - revenue_now DESC, product_id) AS rn FROM ({_S2}) WHERE revenue_before - revenue_now > 0) WHERE rn <= 3 GROUP BY 1) USING (customer_id)""", "revenue_now revenue_before change_pct")
def _b20(w):
    return ops.customer_declines(w.fact("customer_id", "product_id", "month_idx", "revenue", months=12), P(w))


query("j05_two_window_outer", f"SELECT *, {gr('revenue_now', 'revenue_before')} AS change_pct FROM ({_S2})", "revenue_now revenue_before change_pct")(lambda w: ops.six_month_change(w.fact("customer_id", "product_id", "month_idx", "revenue", months=12), P(w), ["customer_id", "product_id"]))


@query("b21_owner_customer_matrix", f"""SELECT owner, customer_id, {d('p')} AS profit, {d('r')} AS revenue, {d('r')}/nullif({d('sum(r) OVER (PARTITION BY customer_id)')},0) AS share FROM (SELECT owner, customer_id, sum(profit) AS p, sum(revenue) AS r FROM fact WHERE {win(12)} AND customer_id IN (
  SELECT customer_id FROM fact WHERE {win(12)} GROUP BY 1 ORDER BY sum(revenue) DESC, customer_id LIMIT 33) GROUP BY 1, 2)""", "profit revenue share")
def _b21(w):
    return ops.owner_customer_matrix(w.fact("owner", "customer_id", "month_idx", "revenue", "profit", months=12), P(w))


_T = ("KA", "AA", "KM", "MM")


@query("b22_monthly_kpi", f"""SELECT month_idx, {d('sum(revenue)')} AS revenue, {d('sum(profit)')} AS profit, {d('sum(qty)')} AS qty, count(DISTINCT customer_id) AS customers, count(DISTINCT product_id) AS products, {', '.join(f"{tot('revenue', f'tier = {t!r}')} AS revenue_{t.lower()}, count(DISTINCT customer_id) FILTER (WHERE tier = '{t}') AS customers_{t.lower()}" for t in _T)} FROM fact GROUP BY 1""", "revenue profit qty " + " ".join(f"revenue_{t.lower()}" for t in _T))
def _b22(w):
    return ops.monthly_kpi(w.fact("month_idx", "customer_id", "product_id", "tier", *ops.M3))


query("b23_customer_month_cells", f"SELECT customer_id, month_idx, {d('revenue')} AS revenue, {d('profit')} AS profit, {d('qty')} AS qty, CASE WHEN revenue > 0 THEN {ratio('profit', 'revenue')}*100 ELSE 0 END AS margin FROM cm", "revenue profit qty margin")(lambda w: ops.customer_month_cells(w.customer_month()))


def _gm(group: str, tail: str = "") -> str:
    return f"SELECT {group}, revenue, profit, {mg('profit', 'revenue')} AS margin, key_revenue, {mg('kp', 'key_revenue')} AS key_margin FROM (SELECT {group}, {d('sum(revenue)')} AS revenue, {d('sum(profit)')} AS profit, {tot('revenue', KEY)} AS key_revenue, {tot('profit', KEY)} AS kp FROM fact WHERE {ytd()} GROUP BY 1) WHERE revenue >= 10000 {tail}"


_GD = "revenue profit margin key_revenue key_margin"
query("b24_line_margins", _gm("product_line"), _GD)(lambda w: ops.group_margins(w.fact("product_line", "tier", "month_idx", "revenue", "profit", months=12), P(w), "product_line"))
query("b24_category_margins", _gm("category", "ORDER BY revenue DESC, category LIMIT 20"), _GD)(lambda w: ops.group_margins(w.fact("category", "tier", "month_idx", "revenue", "profit", months=12), P(w), "category", k=20))


@query("b25_first_bulk", f"""SELECT customer_id, product_id, month_idx, {d('revenue')} AS revenue, {d('profit')} AS profit, {d('qty')} AS qty, owners, CASE WHEN revenue > 0 THEN {ratio('profit', 'revenue')}*100 ELSE 0 END AS margin FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, product_id ORDER BY month_idx) AS rn FROM (
  SELECT customer_id, product_id, month_idx, sum(revenue) AS revenue, sum(profit) AS profit, sum(qty) AS qty, string_agg(DISTINCT owner, ', ' ORDER BY owner) AS owners FROM fact WHERE qty >= {BULK} GROUP BY 1, 2, 3)) WHERE rn = 1""", "revenue profit qty margin")
def _b25(w):
    return ops.first_bulk(w.fact("customer_id", "product_id", "month_idx", "owner", *ops.M3), bulk=BULK)


@query("b26_owner_month_movers", f"""WITH oc AS (SELECT owner, month_idx, customer_id, sum(revenue) AS r FROM fact GROUP BY 1, 2, 3), mv AS (SELECT *, CASE WHEN p > 0 THEN (r-p)/p*100 WHEN r > 0 THEN 0 END AS chg FROM (SELECT owner, month_idx, customer_id, {d('r')} AS r, coalesce({d('max(r) OVER (PARTITION BY owner, customer_id ORDER BY month_idx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)')}, 0) AS p FROM oc) WHERE month_idx > (SELECT min(month_idx) FROM fact)),
  tp AS (SELECT owner, month_idx, string_agg(CAST(customer_id AS VARCHAR), ';' ORDER BY rn) AS movers FROM (SELECT *, row_number() OVER (PARTITION BY owner, month_idx ORDER BY abs(chg) DESC, customer_id) AS rn FROM mv WHERE (p > 0 AND abs(chg) > 50) OR (p <= 0 AND r > 0)) WHERE rn <= 3 GROUP BY 1, 2)
  SELECT g.*, top_customer, top_revenue, movers, {mg('revenue_p', 'revenue')} AS margin, CASE WHEN revenue > 0 THEN new_revenue/revenue*100 ELSE 0 END AS new_share FROM (SELECT owner, month_idx, {d('sum(revenue)')} AS revenue, {d('sum(profit)')} AS profit, {d('sum(qty)')} AS qty, count(DISTINCT customer_id) AS customers, {tot('revenue', 'is_new')} AS new_revenue FROM fact GROUP BY 1, 2) g
  LEFT JOIN (SELECT owner, month_idx, customer_id AS top_customer, {d('r')} AS top_revenue FROM (SELECT *, row_number() OVER (PARTITION BY owner, month_idx ORDER BY r DESC, customer_id) AS rn FROM oc) WHERE rn = 1) USING (owner, month_idx) LEFT JOIN tp USING (owner, month_idx)""".replace("revenue_p", "profit"), "revenue profit qty new_revenue top_revenue margin new_share")
def _b26(w):
    return ops.owner_month_movers(w.fact("owner", "customer_id", "month_idx", "is_new", *ops.M3))


def _dim(name: str, col: str, where: str = "TRUE") -> str:
    return f"SELECT '{name}' AS dimension, CAST({col} AS VARCHAR) AS member, month_idx, {d('sum(revenue)')} AS revenue, {d('sum(profit)')} AS profit, {d('sum(qty)')} AS qty FROM fact WHERE {where} GROUP BY 2, 3"


@query("b27_four_dimension_months", " UNION ALL ".join([_dim("line", "product_line"), _dim("ka_customer", "customer_id", "tier = 'KA'"), _dim("aa_customer", "customer_id", "tier = 'AA'"), _dim("category", "category", "category IN (SELECT category FROM fact GROUP BY 1 ORDER BY sum(revenue) DESC, category LIMIT 10)")]), "revenue profit qty")
def _b27(w):
    return ops.four_dimension_months(w.fact("product_line", "customer_id", "tier", "category", "month_idx", *ops.M3))


_TWD = "revenue_cur revenue_prev revenue_ly profit_cur margin_cur asp_cur margin_hoh margin_yoy revenue_hoh revenue_yoy asp_yoy"


def three(dims: str, src: str = "fact") -> str:
    dd = dims + ", " if dims else ""
    g = f"GROUP BY {dims}" if dims else ""
    return f"""SELECT {dd}revenue_cur, revenue_prev, revenue_ly, profit_cur, margin_cur, revenue_cur/nullif(qty_cur,0) AS asp_cur, margin_cur - margin_prev AS margin_hoh, margin_cur - margin_ly AS margin_yoy, {gr('revenue_cur', 'revenue_prev')} AS revenue_hoh, {gr('revenue_cur', 'revenue_ly')} AS revenue_yoy,
      (revenue_cur/nullif(qty_cur,0) - revenue_ly/nullif(qty_ly,0))/(revenue_ly/nullif(qty_ly,0))*100 AS asp_yoy FROM (SELECT *, {', '.join(f"{mg(f'profit_{n}', f'revenue_{n}')} AS margin_{n}" for n in ('cur', 'prev', 'ly'))} FROM (
      SELECT {dd}{', '.join(sums(half(b), n) for n, b in (('cur', 0), ('prev', 1), ('ly', 2)))} FROM {src} WHERE month_idx >= {HS} - 12 AND month_idx <= {HS} + 5 {g})) WHERE revenue_cur <> 0 OR revenue_ly <> 0 OR revenue_prev <> 0"""


def _tw(name: str, dims: list[str], sql: str | None = None):
    query(name, sql or three(", ".join(dims)), _TWD)(lambda w: ops.three_windows(w.fact(*dims, "month_idx", *ops.M3, months=24), P(w), dims))


_tw("b28_half_overview", [])
_tw("b29_line_windows", ["product_line"])
_tw("b30_department_margins", ["region"])
_tw("b36_category_windows", ["category"])


@query("b31_key_account_halves", f"""SELECT t.*, {gr('m0', 'm1')} AS mom, CASE WHEN revenue_cur > 0 THEN n/revenue_cur*100 ELSE 0 END AS new_share FROM ({three('customer_id, tier', f'(SELECT * FROM fact WHERE {KEY})')}) t JOIN (SELECT customer_id, {tot('revenue', 'month_idx = a')} AS m0, {tot('revenue', f'month_idx = a - 1 AND a - 1 >= {HS}')} AS m1, {tot('revenue', 'is_new')} AS n
  FROM fact, (SELECT max(month_idx) AS a FROM fact WHERE {KEY} AND {half()}) WHERE {KEY} AND {half()} GROUP BY 1) USING (customer_id) WHERE revenue_cur <> 0""", _TWD + " mom new_share")
def _b31(w):
    return ops.key_account_halves(w.fact("customer_id", "tier", "is_new", "month_idx", *ops.M3, months=24), P(w))


@query("b32_new_product_survival", f"""SELECT product_id, first_date, active_months, active_months/12.0*100 AS survival, revenue, {mg('profit', 'revenue')} AS margin, customers FROM (SELECT product_id, first_date, count(DISTINCT month_idx) AS active_months, {d('sum(revenue)')} AS revenue, {d('sum(profit)')} AS profit, count(DISTINCT customer_id) AS customers
  FROM fact JOIN (SELECT product_id, min(ship_date) AS first_date FROM fact WHERE product_id IN (SELECT product_id FROM fact WHERE is_new) GROUP BY 1) USING (product_id) WHERE ship_date <= first_date + INTERVAL 12 MONTH GROUP BY 1, 2)""", "survival revenue margin")
def _b32(w):
    return ops.new_product_survival(w.fact("product_id", "customer_id", "ship_date", "month_idx", "is_new", *ops.M3))


def _attr(key: str, src: str) -> str:
    return f"SELECT {key}, product_id, revenue_cur, margin_cur, revenue_ly, margin_cur - margin_yoy AS margin_ly, margin_yoy AS margin_change, revenue_ly < 1000 AS is_new_item, revenue_cur*margin_yoy/100 AS impact FROM ({three(f'{key}, product_id', src)}) WHERE revenue_cur >= 5000"


_MIN = 100_000.0
_KA = f"(SELECT * FROM fact WHERE {KEY})"


@query("b33_margin_issues", f"""WITH c AS (SELECT * FROM ({three('customer_id', _KA)}) WHERE margin_yoy < -3 AND revenue_cur > {_MIN}), n AS (SELECT customer_id, {cnt('margin_change < -3 AND NOT is_new_item')} AS pd, {cnt('is_new_item AND a.margin_cur < c.margin_cur')} AS nl FROM ({_attr('customer_id', _KA)}) a JOIN (SELECT customer_id, margin_cur FROM c) c USING (customer_id) GROUP BY 1)
  SELECT 'line_margin_down' AS issue, product_line AS target, revenue_cur, margin_cur, margin_yoy, CAST(NULL AS VARCHAR) AS cause FROM ({three('product_line')}) WHERE margin_yoy < -2 AND revenue_cur > {_MIN} UNION ALL
  SELECT 'department_margin_low', region, revenue_cur, margin_cur, margin_yoy, NULL FROM ({three('region')}) WHERE margin_cur < (SELECT margin_cur FROM ({three('')})) - 3 AND revenue_cur > {_MIN} UNION ALL
  SELECT 'key_account_margin_down', CAST(customer_id AS VARCHAR), revenue_cur, margin_cur, margin_yoy, CASE WHEN coalesce(pd,0) >= coalesce(nl,0) THEN 'price' WHEN nl > 0 THEN 'mix' ELSE 'mixed' END FROM c LEFT JOIN n USING (customer_id)""", "revenue_cur margin_cur margin_yoy")
def _b33(w):
    return ops.margin_issues(w.fact("customer_id", "product_id", "product_line", "region", "tier", "month_idx", *ops.M3, months=24), P(w), min_revenue=_MIN)


@query("b34_margin_attribution", _attr("region", "fact"), "revenue_cur margin_cur revenue_ly margin_ly margin_change impact")
def _b34(w):
    return ops.margin_attribution(w.fact("region", "product_id", "month_idx", *ops.M3, months=24), P(w), ["region"])


@query("b35_product_halves", f"""WITH big AS (SELECT product_id, {d('sum(revenue)')} AS revenue_12m, bool_or(is_new) AS is_new FROM fact WHERE {win(12)} GROUP BY 1 HAVING sum(revenue) > 100000) SELECT big.*, t.* EXCLUDE (product_id), top_customers, trend_months FROM big LEFT JOIN ({three('product_id')}) t ON t.product_id = big.product_id
  LEFT JOIN (SELECT product_id, string_agg(CAST(customer_id AS VARCHAR), ';' ORDER BY rn) AS top_customers FROM (SELECT product_id, customer_id, row_number() OVER (PARTITION BY product_id ORDER BY sum(revenue) DESC, customer_id) AS rn FROM fact WHERE {win(12)} GROUP BY 1, 2) WHERE rn <= 5 GROUP BY 1) tc ON tc.product_id = big.product_id
  LEFT JOIN (SELECT product_id, CAST(count(DISTINCT month_idx) AS INT) AS trend_months FROM fact WHERE {win(24)} GROUP BY 1) tm ON tm.product_id = big.product_id""", "revenue_12m " + _TWD)
def _b35(w):
    return ops.product_halves(w.fact("product_id", "customer_id", "is_new", "month_idx", *ops.M3, months=24), P(w)).drop("trend")


@query("b37_geography", f"""SELECT region, revenue, profit, customers, {mg('profit', 'revenue')} AS margin, revenue/sum(revenue) OVER ()*100 AS share, {gr('revenue_m0', 'revenue_m1')} AS mom, top_customers, top_lines FROM (SELECT region, {d('sum(revenue)')} AS revenue, {d('sum(profit)')} AS profit, count(DISTINCT customer_id) AS customers, {sums(mo(0), 'm0')}, {sums(mo(1), 'm1')} FROM fact WHERE {win(12)} GROUP BY 1)
  JOIN (SELECT region, string_agg(CAST(customer_id AS VARCHAR), ';' ORDER BY rn) AS top_customers FROM (SELECT region, customer_id, row_number() OVER (PARTITION BY region ORDER BY sum(revenue) DESC, customer_id) AS rn FROM fact WHERE {win(12)} GROUP BY 1, 2) WHERE rn <= 5 GROUP BY 1) USING (region)
  JOIN (SELECT region, string_agg(product_line, ';' ORDER BY rn) AS top_lines FROM (SELECT region, product_line, row_number() OVER (PARTITION BY region ORDER BY sum(revenue) DESC, product_line) AS rn FROM fact WHERE {win(12)} GROUP BY 1, 2) WHERE rn <= 5 GROUP BY 1) USING (region)""", "revenue profit margin share mom")
def _b37(w):
    return ops.geography(w.fact("region", "customer_id", "product_line", "month_idx", "revenue", "profit", months=12), P(w))


_C5 = (("m0", mo(0)), ("m1", mo(1)), ("m12", mo(12)), ("ytd", ytd()), ("py", ytd(1)))


@query("b38_top_products", f"""WITH g AS (SELECT product_id, {', '.join(sums(c, n, ('revenue', 'profit')) for n, c in _C5)} FROM fact WHERE month_idx > {Y}*12 - 12 GROUP BY 1), t AS (SELECT * FROM g WHERE revenue_m0 > 0 ORDER BY revenue_m0 DESC, product_id LIMIT 20),
  b AS (SELECT product_id, customer_id AS top_customer, v FROM (SELECT product_id, customer_id, {d('sum(revenue)')} AS v, row_number() OVER (PARTITION BY product_id ORDER BY sum(revenue) DESC, customer_id) AS rn FROM fact WHERE {mo(0)} GROUP BY 1, 2) WHERE rn = 1),
  u AS (SELECT t.*, top_customer, v FROM t LEFT JOIN b USING (product_id) UNION ALL SELECT NULL, {', '.join(f'sum({m}_{n})' for n, _ in _C5 for m in ('revenue', 'profit'))}, NULL, NULL FROM t)
  SELECT product_id, revenue_m0, {gr('revenue_m0', 'revenue_m1')} AS mom, {gr('revenue_m0', 'revenue_m12')} AS yoy, revenue_ytd, {gr('revenue_ytd', 'revenue_py')} AS ytd_yoy, {mg('profit_m0', 'revenue_m0')} AS margin, {mg('profit_m0', 'revenue_m0')} - {mg('profit_m1', 'revenue_m1')} AS margin_change, top_customer, v/revenue_m0*100 AS top_customer_share FROM u""", "revenue_m0 mom yoy revenue_ytd ytd_yoy margin margin_change top_customer_share")
def _b38(w):
    return ops.top_products(w.fact("product_id", "customer_id", "month_idx", "revenue", "profit", months=24), P(w))


@query("b39_portrait_history_series", f"SELECT product_id, string_agg(portrait, ';' ORDER BY as_of) AS portraits, sum(margin) AS margin_sum FROM pp WHERE as_of < {LM} AND as_of >= {LM} - 12 GROUP BY 1", "margin_sum")
def _b39(w):
    h = ops.history_series(w.product_portrait(range(1, 21)))
    return h.select("product_id", F.array_join(F.transform("series", lambda x: x["portrait"]), ";").alias("portraits"), F.aggregate("series", F.lit(0.0), lambda a, x: a + x["margin"]).alias("margin_sum"))


@query("b40_product_monthly_series", f"SELECT product_id, month_idx, {d('qty')} AS qty, CASE WHEN revenue IS NULL THEN NULL WHEN revenue > 0 THEN {ratio('profit', 'revenue')}*100 ELSE 0 END AS margin FROM (SELECT DISTINCT product_id FROM pm WHERE {win(12)}) p CROSS JOIN (SELECT CAST(unnest(range({LM} - 11, {LM} + 1)) AS INT) AS month_idx) LEFT JOIN (SELECT product_id, month_idx, qty, revenue, profit FROM pm) USING (product_id, month_idx)", "qty margin")
def _b40(w):
    return ops.monthly_series(w.product_month(months=12), w.latest)


@query("b41_portrait_migration", f"""WITH m AS (SELECT product_id, quarter, portrait FROM (SELECT product_id, CAST((as_of-1)//3 AS INT) AS quarter, portrait, row_number() OVER (PARTITION BY product_id, (as_of-1)//3 ORDER BY count(*) DESC, max(as_of) DESC) AS rn FROM pp WHERE as_of < {LM} GROUP BY product_id, (as_of-1)//3, portrait) WHERE rn = 1)
  SELECT a.quarter, a.portrait AS from_portrait, b.portrait AS to_portrait, count(*) AS products FROM m a JOIN m b ON a.product_id = b.product_id AND b.quarter = a.quarter + 1 GROUP BY 1, 2, 3""")
def _b41(w):
    return ops.portrait_migration(w.product_portrait(range(1, 21)))


_DC = ("portrait", "risk_level", "pareto", "zone", "branch")
query("b42_distribution_counts", " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM pp WHERE as_of = {LM} GROUP BY 2" for c in _DC))(lambda w: ops.distribution_counts(w.product_portrait(), _DC))
query("b43_filter_values", " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS dimension, {c} AS value FROM pp WHERE as_of = {LM} AND {c} IS NOT NULL" for c in ("category", "product_line", "portrait")))(lambda w: ops.filter_values(w.product_portrait(), ("category", "product_line", "portrait")))


@query("b44_product_kpi", f"""SELECT count(*) AS products, {cnt("risk_level IN ('high','very_high')")} AS high_risk, {cnt("portrait IN ('decline','sunset','hidden_decline')")} AS declining, {cnt("portrait IN ('growth','healthy_expansion')")} AS growing, sum(margin*r12_q) FILTER (WHERE r12_q > 0)/sum(r12_q) FILTER (WHERE r12_q > 0) AS weighted_margin, avg(growth) AS mean_growth FROM pp WHERE as_of = {LM}""", "weighted_margin mean_growth")
def _b44(w):
    return ops.product_kpi(w.product_portrait())


query("b45_product_bubbles", f"SELECT product_id, portrait, risk_level, growth, margin, r12_r, r12_q FROM pp WHERE as_of = {LM}", "growth margin r12_r r12_q")(lambda w: w.product_portrait().select("product_id", "portrait", "risk_level", "growth", "margin", "r12_r", "r12_q"))
query("b47_window_anchor", f"SELECT a AS anchor, CASE WHEN a - 1 >= {HS} THEN a - 1 END AS anchor_prev FROM (SELECT max(month_idx) AS a FROM fact WHERE {half()})")(lambda w: ops.window_anchor(w.fact("month_idx", months=12), P(w)))
