"""Product portrait, its parts, its history."""

from pyspark.sql import functions as F

from ..operators import product as ops
from .registry import cte, query
from .sqlbits import LM, clip

OFFSETS = range(0, 21)

cte(
    "k_rows",
    f"""SELECT r.*, as_of, as_of - month_idx AS back, CASE WHEN qty <> 0 THEN rev_pos/qty END AS avg_price FROM (
      SELECT product_id, month_idx, CAST(sum(qty) AS DOUBLE) AS qty, CAST(sum(greatest(revenue, 0)) AS DOUBLE) AS rev_pos, CAST(sum(profit) AS DOUBLE) AS profit,
        max(qty) AS max_row_qty, bool_or(is_new) AS is_new, max(category) AS category, max(product_line) AS product_line FROM fact GROUP BY 1, 2) r
      JOIN (SELECT CAST(unnest(range({LM} - 20, {LM} + 1)) AS INT) AS as_of) ON month_idx <= as_of""",
)


def _aggs() -> str:
    out = []
    for w, (n, s) in ops.WINDOWS.items():
        cond = f"back >= {s} AND back < {s + n}"
        out += [f"coalesce(sum({m}) FILTER (WHERE {cond}), 0) AS {w}_{x}" for m, x in (("qty", "q"), ("rev_pos", "r"), ("profit", "p"))]
        out.append(f"count(*) FILTER (WHERE {cond}) AS {w}_m")
    return ", ".join(out)


def _per(w: str) -> str:
    return f"(CASE WHEN {w}_m > 0 THEN {w}_q/{w}_m ELSE 0 END)"


def _rate(n: str, dn: str) -> str:
    return f"(CASE WHEN {_per(dn)} > 0 THEN ({_per(n)} - {_per(dn)})/{_per(dn)} END)"


_OK = {w: f"({w}_m >= 2 AND {w}_q > 0)" for w in ("p12", "p6", "p3")}
_G = f"""CASE WHEN {_OK['p12']} THEN ({_per('r12')} - p12_q/p12_m)/(p12_q/p12_m)
  WHEN {_OK['p6']} THEN (CASE WHEN l3_m+p3_m > 0 THEN (l3_q+p3_q)/(l3_m+p3_m) ELSE 0 END - p6_q/p6_m)/(p6_q/p6_m)
  WHEN {_OK['p3']} THEN ({_per('l3')} - p3_q/p3_m)/(p3_q/p3_m) ELSE 0 END"""
cte(
    "k_win",
    f"""SELECT product_id, as_of, min(month_idx) AS first_idx, max(month_idx) AS last_idx, count(*) AS active_months, max(as_of) - min(month_idx) + 1 AS age,
      min(CASE WHEN max_row_qty >= 6000 THEN month_idx END) AS first_bulk_idx, coalesce(bool_or(is_new) FILTER (WHERE back < 12), FALSE) AS is_new,
      count(*) FILTER (WHERE back < 24 AND qty > 0) AS active_24m, max(category) AS category, max(product_line) AS product_line, {_aggs()} FROM k_rows GROUP BY 1, 2""",
)
cte(
    "k_growth",
    f"""SELECT *, margin > prior_margin AS better FROM (SELECT *, {clip('graw', -1.0, 5.0)} AS growth, {clip('rgraw', -1.0, 5.0)} AS rev_growth FROM (
      SELECT *, {_G} AS graw, CASE WHEN {_OK['p12']} THEN '12m' WHEN {_OK['p6']} THEN '6m' WHEN {_OK['p3']} THEN '3m' ELSE 'none' END AS growth_window,
        CASE WHEN r12_r > 0 THEN r12_p/r12_r ELSE 0 END AS margin, CASE WHEN p12_r > 0 THEN p12_p/p12_r ELSE 0 END AS prior_margin,
        CASE WHEN p12_r > 0 AND p12_m >= 2 THEN (CASE WHEN r12_m > 0 THEN r12_r/r12_m ELSE 0 END - p12_r/p12_m)/(p12_r/p12_m) ELSE 0 END AS rgraw FROM k_win WHERE age >= 3))""",
)
cte(
    "k_decay",
    f"""SELECT *, CASE WHEN growth_change_pp IS NULL THEN NULL WHEN growth_change_pp > 0 THEN 'accelerating' WHEN growth_change_pp = 0 THEN 'flat' ELSE 'decelerating' END AS growth_direction FROM (
      SELECT *, graw <> growth AS growth_clamped, (margin - prior_margin)*100 AS margin_yoy_pp,
        CASE WHEN rev_growth > 0 AND better THEN 'both_up' WHEN rev_growth > 0 THEN 'revenue_up_margin_down' WHEN better THEN 'revenue_down_margin_up' ELSE 'both_down' END AS rev_profit,
        CASE WHEN r12_r >= 1000000 THEN 'key' WHEN r12_r >= 100000 THEN 'regular' ELSE 'potential' END AS pareto,
        (coalesce({_rate('l3', 'p3')}, 0) - growth)*100 AS decay_pp, CASE WHEN age >= 15 THEN {_rate('l3', 'y3')} END AS yoy_3m,
        CASE WHEN age >= 24 THEN coalesce({_rate('p12', 'p24')}, 0) END AS prior_growth,
        CASE WHEN age >= 24 THEN (growth - coalesce({_rate('p12', 'p24')}, 0))*100 WHEN age >= 12 THEN growth*100 END AS growth_change_pp FROM k_growth)""",
)
cte(
    "k_ref",
    """SELECT product_id, as_of, CASE WHEN n IS NULL THEN 0 WHEN age < 12 AND n < 6 THEN q30 WHEN age < 12 THEN q50 WHEN n >= 20 THEN q95 ELSE q90 END AS hist_margin,
      CASE WHEN age >= 36 THEN ql END AS long_margin, n IS NULL AS no_hist FROM (SELECT product_id, as_of, age FROM k_win WHERE age >= 3) LEFT JOIN (
        SELECT product_id, as_of, count(*) AS n, quantile_cont(m, 0.95) AS q95, quantile_cont(m, 0.9) AS q90, quantile_cont(m, 0.5) AS q50, quantile_cont(m, 0.3) AS q30,
          quantile_cont(CASE WHEN rn <= 24 THEN m END, 0.8) AS ql FROM (
          SELECT *, row_number() OVER (PARTITION BY product_id, as_of ORDER BY back) AS rn FROM (SELECT *, profit/nullif(rev_pos, 0) AS m FROM k_rows) WHERE m > 0) GROUP BY 1, 2) USING (product_id, as_of)""",
)
cte(
    "k_slope",
    """SELECT product_id, as_of, count(*) AS slope_points, coalesce(CASE WHEN count(*) >= 3 AND avg(y) > 0 THEN round(regr_slope(y, x)/avg(y), 10) END, 0) AS slope_ratio, max(y) <= 0.001 AS zero_profit FROM (
      SELECT *, greatest(profit, 0) AS y, CAST(row_number() OVER (PARTITION BY product_id, as_of ORDER BY month_idx) AS DOUBLE) AS x FROM k_rows WHERE back < 6) GROUP BY 1, 2""",
)
cte(
    "k_vol",
    """SELECT product_id, as_of, CASE WHEN q <= 0 THEN NULL WHEN mean < 1000 AND n >= 6 THEN CASE WHEN med > 0 THEN mad/med ELSE 0 END WHEN act <= 4 AND q > 1000 THEN 0.5
        ELSE CASE WHEN mean > 0 THEN sd/mean ELSE 0 END END AS order_cv,
      CASE WHEN q <= 0 THEN 'yes' WHEN mean < 1000 AND n >= 6 THEN 'yes' WHEN act <= 4 AND q > 1000 THEN 'pulse' ELSE 'no' END AS low_volume FROM (
      SELECT product_id, as_of, sum(qty) AS q, count(*) AS n, avg(qty) AS mean, stddev_samp(qty) AS sd, max(med) AS med, quantile_cont(abs(qty - med), 0.5) AS mad, count(*) FILTER (WHERE qty > 0) AS act
      FROM (SELECT *, quantile_cont(qty, 0.5) OVER (PARTITION BY product_id, as_of) AS med FROM k_rows WHERE back < 12) GROUP BY 1, 2)""",
)
cte(
    "k_fall",
    """SELECT product_id, as_of, CAST(min(r - 1) FILTER (WHERE NOT fell OR r >= least(13, n)) AS INT) AS consecutive_falls FROM (
      SELECT product_id, as_of, row_number() OVER (PARTITION BY product_id, as_of ORDER BY back) AS r, count(*) OVER (PARTITION BY product_id, as_of) AS n,
        coalesce(qty < lag(qty) OVER (PARTITION BY product_id, as_of ORDER BY month_idx), FALSE) AS fell FROM k_rows) GROUP BY 1, 2""",
)
cte(
    "k_asp",
    """SELECT product_id, as_of, CASE WHEN count(y) >= 3 THEN round(regr_slope(y, x)/avg(y), 10) ELSE 0 END AS asp_slope, count(y) >= 3 AS asp_reliable FROM (
      SELECT *, CASE WHEN avg_price > 0 THEN avg_price END AS y, CAST(row_number() OVER (PARTITION BY product_id, as_of ORDER BY month_idx) AS DOUBLE) AS x FROM k_rows WHERE back < 12) GROUP BY 1, 2""",
)
cte(
    "k_conc",
    f"""SELECT product_id, as_of, coalesce(v1/nullif(t,0), 0) AS top1, CASE WHEN t = 0 THEN 0 WHEN n < 3 THEN 1 ELSE v3/t END AS top3 FROM (
      SELECT product_id, as_of, sum(v) AS t, count(*) AS n, max(v) FILTER (WHERE rn = 1) AS v1, sum(v) FILTER (WHERE rn <= 3) AS v3 FROM (
        SELECT product_id, as_of, v, row_number() OVER (PARTITION BY product_id, as_of ORDER BY v DESC, customer_id) AS rn FROM (
          SELECT product_id, as_of, customer_id, CAST(sum(revenue) AS DOUBLE) AS v FROM fact JOIN (SELECT CAST(unnest(range({LM} - 20, {LM} + 1)) AS INT) AS as_of)
            ON month_idx <= as_of AND month_idx > as_of - 12 GROUP BY 1, 2, 3)) GROUP BY 1, 2)""",
)
cte(
    "k_prof",
    """SELECT *, CASE WHEN age >= 24 AND active_24m <= 1 AND r12_q = 0 THEN 'zombie' WHEN is_new THEN 'new' ELSE 'normal' END AS branch, NOT no_hist AND margin < 0 AS negative_margin,
      CASE WHEN no_hist OR margin < 0 THEN 0 WHEN hist_margin > 0 THEN margin/hist_margin ELSE 1 END AS self_health, NOT zero_profit AND slope_points < 3 AS slope_short,
      CASE WHEN zero_profit THEN 'no_profit' WHEN slope_points < 3 THEN 'too_few' WHEN slope_ratio >= 0 THEN 'stable_or_rising' WHEN slope_ratio > -0.003 THEN 'mild_decline'
        WHEN slope_ratio > -0.008 THEN 'clear_erosion' ELSE 'fast_erosion' END AS slope_level,
      CASE WHEN asp_slope > 0.005 THEN 'rising' WHEN asp_slope < -0.005 THEN 'falling' ELSE 'flat' END AS asp_direction,
      CASE WHEN asp_slope < -0.005 AND slope_ratio < -0.003 THEN 'price_war' WHEN asp_slope > -0.005 AND slope_ratio < -0.003 THEN 'cost_problem'
        WHEN asp_slope < -0.005 AND slope_ratio > -0.003 THEN 'scale_effect' ELSE 'normal' END AS joint_diagnosis, last_idx <= as_of - 12 AND last_idx - first_idx + 1 >= 3 AS exited
    FROM (SELECT d.*, hist_margin, long_margin, no_hist, coalesce(slope_points, 0) AS slope_points, coalesce(slope_ratio, 0) AS slope_ratio, coalesce(zero_profit, FALSE) AS zero_profit,
        order_cv, coalesce(low_volume, 'yes') AS low_volume, coalesce(consecutive_falls, 0) AS consecutive_falls, coalesce(asp_slope, 0) AS asp_slope, coalesce(asp_reliable, FALSE) AS asp_reliable,
        coalesce(top1, 0) AS top1, coalesce(top3, 0) AS top3
      FROM k_decay d LEFT JOIN k_ref USING (product_id, as_of) LEFT JOIN k_slope USING (product_id, as_of) LEFT JOIN k_vol USING (product_id, as_of)
      LEFT JOIN k_fall USING (product_id, as_of) LEFT JOIN k_asp USING (product_id, as_of) LEFT JOIN k_conc USING (product_id, as_of))""",
)
cte("k_base", "SELECT * FROM k_prof WHERE branch = 'normal' AND NOT exited AND r12_r > 0")
cte(
    "k_grp",
    """SELECT p.*, coalesce(company_margin, 0) AS company_margin, CASE WHEN cn >= 3 THEN cmg WHEN ln >= 3 THEN lmg ELSE coalesce(company_margin, 0) END AS group_margin,
      CASE WHEN cn >= 3 THEN 'category' WHEN ln >= 3 THEN 'product_line' ELSE 'company' END AS group_source FROM k_prof p
    LEFT JOIN (SELECT as_of, sum(margin*r12_r)/sum(r12_r) AS company_margin FROM k_base GROUP BY 1) USING (as_of)
    LEFT JOIN (SELECT as_of, category, sum(margin*r12_r)/sum(r12_r) AS cmg, count(*) AS cn FROM k_base GROUP BY 1, 2) USING (as_of, category)
    LEFT JOIN (SELECT as_of, product_line, sum(margin*r12_r)/sum(r12_r) AS lmg, count(*) AS ln FROM k_base GROUP BY 1, 2) USING (as_of, product_line)""",
)
_GRID = " ".join(f"WHEN momentum = '{m}' AND health = '{h}' THEN '{p}'" for m, h, p, _ in ops.GRID)
_ZONE = " ".join(f"WHEN momentum = '{m}' AND health = '{h}' THEN '{z}'" for m, h, _, z in ops.GRID)
_CELL = " ".join(
    f"WHEN yg = '{y}' AND dg = '{d}' THEN {s}" for y, row in ops.DECAY_SCORES.items() for d, s in row.items()
)
cte(
    "k_class",
    f"""SELECT *, CASE branch WHEN 'zombie' THEN 'clearance' WHEN 'new' THEN 'new_watch' ELSE CASE {_GRID} ELSE 'unclassified' END END AS portrait,
      CASE branch WHEN 'zombie' THEN 'exit' WHEN 'new' THEN 'watch' ELSE CASE {_ZONE} ELSE 'watch' END END AS zone,
      CASE WHEN yoy_3m IS NULL THEN 'unknown' WHEN yoy_3m > 0.5 THEN 'high_growth' WHEN yoy_3m > 0 THEN 'growing' WHEN yoy_3m > -0.1 THEN 'flat' ELSE 'shrinking' END AS yg,
      CASE WHEN decay_pp > 0 THEN 'accelerating' WHEN decay_pp >= -10 THEN 'stable' ELSE 'decelerating' END AS dg FROM (
      SELECT *, CASE WHEN growth > 0.15 THEN 'accelerating' WHEN growth > 0 THEN 'expanding' WHEN growth > -0.1 THEN 'flat' ELSE 'shrinking' END AS momentum,
        CASE WHEN self_health < 0.5 OR relative_health_pp < -10 THEN 'severe' WHEN self_health >= 0.7 AND relative_health_pp >= 0 THEN 'healthy' ELSE 'mild' END AS health FROM (
        SELECT *, CASE WHEN group_margin > 0 THEN (margin - group_margin)*100 ELSE 0 END AS relative_health_pp, (margin - company_margin)*100 AS vs_company_pp FROM k_grp))""",
)
_STRAT = " ".join(f"WHEN portrait = '{k}' THEN '{v}'" for k, v in ops.BASE_STRATEGY.items())
cte(
    "k_score",
    f"""SELECT *, CASE WHEN growth > 1 AND decay_pp < -100 AND NOT decay_cap_removed THEN least(s4, 50) ELSE s4 END AS s_decay,
      NOT slope_short AND NOT zero_profit AS ok1, NOT no_hist AS ok3 FROM (
      SELECT *, CASE WHEN slope_short THEN 50 WHEN zero_profit THEN 80 WHEN slope_ratio > 0 THEN 10 WHEN slope_ratio > -0.008 THEN 50 ELSE 80 END AS s_slope,
        coalesce(growth > 1 AND decay_pp < -100 AND yoy_3m <= 0, FALSE) AS decay_cap_removed,
        CASE WHEN consecutive_falls > 0 THEN least(100, (CASE {_CELL} ELSE 50 END) + least(consecutive_falls*5, 25)) ELSE (CASE {_CELL} ELSE 50 END) END AS s4,
        CASE WHEN no_hist THEN 50 WHEN self_health > 0.7 THEN 10 WHEN self_health > 0.5 THEN 40 ELSE 70 END AS s_health,
        CASE WHEN portrait = 'decline' AND margin_yoy_pp > 10 THEN 'margin recovers strongly: confirm it lasts before exit' WHEN portrait = 'decline' AND margin_yoy_pp > 0 THEN 'margin recovers a little: watch before exit'
          WHEN portrait = 'decline' AND r12_q = 0 THEN 'no shipments: confirm exit and clear stock' WHEN portrait = 'decline' THEN 'volume and profit fall: plan exit'
          WHEN portrait = 'sunset' AND margin_yoy_pp > 5 THEN 'margin clearly recovers: control stock, delay replacement' WHEN portrait = 'sunset' AND margin_yoy_pp > 0 THEN 'demand fades, profit fair: plan replacement'
          WHEN portrait = 'sunset' THEN 'demand fades: prepare replacement' WHEN portrait = 'hidden_decline' AND margin_yoy_pp > 0 THEN 'margin below history but recovering: watch'
          WHEN portrait = 'hidden_decline' THEN 'stable on the surface, profit erodes: warn'
          WHEN portrait = 'warning_growth' AND rev_profit = 'revenue_down_margin_up' THEN 'volume up, profit under its peak: follow the recovery'
          WHEN portrait = 'warning_growth' THEN 'growth hides falling profit: check cost' {_STRAT} ELSE '' END AS strategy FROM k_class)""",
)
cte(
    "k_total",
    """SELECT *, t <= 68 AND s_decay >= 80 AND s_slope >= 70 AS override FROM (
      SELECT *, CASE WHEN portrait = 'decline' AND (margin <= 0 OR r12_q <= 0) AND rest < 50 THEN greatest(50, total) ELSE total END AS t FROM (
      SELECT *, (s_slope*(CASE WHEN ok1 THEN CAST(0.1 AS DOUBLE) ELSE 0 END) + s_decay*CAST(0.6 AS DOUBLE) + s_health*(CASE WHEN ok3 THEN CAST(0.2 AS DOUBLE) ELSE 0 END))
          /((CASE WHEN ok1 THEN CAST(0.1 AS DOUBLE) ELSE 0 END) + CAST(0.6 AS DOUBLE) + (CASE WHEN ok3 THEN CAST(0.2 AS DOUBLE) ELSE 0 END)) AS total,
        (s_slope*(CASE WHEN ok1 THEN CAST(0.1 AS DOUBLE) ELSE 0 END) + s_decay*CAST(0.6 AS DOUBLE))/((CASE WHEN ok1 THEN CAST(0.1 AS DOUBLE) ELSE 0 END) + CAST(0.6 AS DOUBLE)) AS rest,
        CASE WHEN ok1 THEN s_slope*CAST(0.1 AS DOUBLE) ELSE 0 END AS c1, s_decay*CAST(0.6 AS DOUBLE) AS c2, CASE WHEN ok3 THEN s_health*CAST(0.2 AS DOUBLE) ELSE 0 END AS c3 FROM k_score))""",
)
cte(
    "pp",
    """SELECT *, CASE WHEN branch <> 'normal' THEN 'unscored' WHEN risk_score <= 55 THEN 'low' WHEN risk_score <= 65 THEN 'medium' WHEN risk_score <= 68 THEN 'high' ELSE 'very_high' END AS risk_level,
      CASE WHEN branch = 'normal' THEN CASE WHEN c1 >= c2 AND c1 >= c3 THEN 'slope' WHEN c2 >= c3 THEN 'decay' ELSE 'health' END END AS main_factor,
      CASE WHEN branch = 'normal' THEN coalesce(nullif(concat_ws(',', CASE WHEN zero_profit THEN 'ZP' END, CASE WHEN negative_margin THEN 'NM' END, CASE WHEN slope_short THEN 'SL' END,
        CASE WHEN growth_clamped THEN 'GC' END, CASE WHEN r12_q = 0 THEN 'ZS' END, CASE WHEN no_hist THEN 'NH' END), ''), 'reliable') END AS quality
    FROM (SELECT *, CASE WHEN branch = 'normal' THEN CASE WHEN override THEN greatest(t, 69) ELSE t END END AS risk_score FROM k_total)""",
)

_PARTS = {
    "a43_window_aggregates": (
        "product_id, as_of, " + ", ".join(f"{w}_{x}" for w in ops.WINDOWS for x in "qrpm"), "k_win",
        lambda rows, info: ops.window_aggregates(rows), " ".join(f"{w}_{x}" for w in ops.WINDOWS for x in "qrp"),
    ),
    "r13_reference_margin": ("product_id, as_of, hist_margin, long_margin, no_hist", "k_ref", lambda rows, info: ops.reference_margin(rows, info), "hist_margin long_margin"),
    "r14_profit_slope": ("*", "k_slope", lambda rows, info: ops.profit_slope(rows), "slope_ratio"),
    "r15_order_volatility": ("*", "k_vol", lambda rows, info: ops.order_volatility(rows), "order_cv"),
    "w06_decline_streak": ("*", "k_fall", lambda rows, info: ops.decline_streak(rows), ""),
}
for _name, (_cols, _src, _fn, _dbl) in _PARTS.items():
    def _run(w, fn=_fn):
        rows = ops.at_cutoffs(w.portrait_months(), [w.latest])
        return fn(rows, ops.product_info(rows).filter(F.col("age") >= 3))

    query(_name, f"SELECT {_cols} FROM {_src} WHERE as_of = {LM}", _dbl)(_run)


def _pick(name: str, cols: str, doubles: str = "", where: str = f"as_of = {LM}"):
    query(name, f"SELECT product_id, {cols} FROM pp WHERE {where}", doubles)(
        lambda w: w.product_portrait().select("product_id", *[x.strip() for x in cols.split(",")])
    )


_pick("r12_growth_window", "growth, growth_window, growth_clamped", "growth")
_pick("r16_growth_decay", "decay_pp, yoy_3m, prior_growth, growth_change_pp, growth_direction", "decay_pp yoy_3m prior_growth growth_change_pp")
_pick("r18_joint_diagnosis", "asp_slope, asp_reliable, asp_direction, joint_diagnosis", "asp_slope")
_pick("r10_nine_grid", "growth, momentum, self_health, relative_health_pp, health, portrait, zone, strategy", "growth self_health relative_health_pp")
_pick("r26_product_scoring", "s_slope, s_decay, s_health, override, decay_cap_removed, risk_score, risk_level, main_factor, quality", "risk_score")
_pick("a42_reference_groups", "company_margin, group_margin, group_source, vs_company_pp", "company_margin group_margin vs_company_pp")
_pick("r27_product_branches", "branch, age, active_months, active_24m, is_new, exited, r12_q, margin, self_health", "r12_q margin self_health")

_COLS = (
    "first_idx, last_idx, active_months, age, first_bulk_idx, is_new, category, product_line, r12_q, p12_q, r12_r, p12_r, growth, growth_window, margin, prior_margin, margin_yoy_pp,"
    " rev_growth, rev_profit, pareto, hist_margin, long_margin, self_health, relative_health_pp, group_margin, company_margin, slope_ratio, slope_level, asp_slope, asp_direction,"
    " joint_diagnosis, order_cv, low_volume, decay_pp, yoy_3m, prior_growth, growth_direction, consecutive_falls, top1, top3, momentum, health, portrait, zone, strategy, branch, exited,"
    " risk_score, risk_level, main_factor, quality"
)
_PP_DBL = (
    "r12_q p12_q r12_r p12_r growth margin prior_margin margin_yoy_pp rev_growth hist_margin long_margin self_health relative_health_pp group_margin company_margin slope_ratio asp_slope"
    " order_cv decay_pp yoy_3m prior_growth top1 top3 risk_score"
)
_pick("r28_product_portrait", _COLS, _PP_DBL)


@query(
    "r29_portrait_history",
    f"SELECT product_id, as_of, portrait, zone, risk_score, risk_level, margin, growth, r12_q FROM pp WHERE as_of < {LM}",
    "risk_score margin growth r12_q",
)
def _r29(w):
    h = w.product_portrait(range(1, 21))
    return h.select("product_id", "as_of", "portrait", "zone", "risk_score", "risk_level", "margin", "growth", "r12_q")


@query("a44_exited_lifespan", f"SELECT as_of, category, quantile_cont(CAST(last_idx - first_idx + 1 AS DOUBLE), 0.5) AS median_life, count(*) AS products FROM pp WHERE exited AND as_of = {LM} GROUP BY 1, 2 HAVING count(*) >= 3", "median_life")
def _a44(w):
    return ops.exited_lifespan(w.product_portrait())


_ZERO, _NOM = "r12_q = 0", "(no_hist OR slope_level = 'no_profit')"
_NOTES = [
    ("override", "'double factor override: very high risk'"), ("negative_margin", "'loss making over 12 months'"), (_ZERO, "'no shipments in 12 months'"), ("consecutive_falls >= 4", "'volume fell ' || consecutive_falls || ' months in a row: risk signal'"),
    ("group_source = 'company'", "'too few peers: relative health for reference only'"), ("no_hist", "'no valid margin history'"), ("slope_level = 'no_profit'", "'no profit in the last months'"), ("growth_window <> '12m'", "'growth based on window ' || growth_window"),
    ("growth_direction = 'decelerating'", "'growth is slowing'"), ("top1 > 0.5", "'depends on one customer'"), ("slope_level IN ('clear_erosion', 'fast_erosion')", "'profit falls steadily'"),
    (f"NOT ({_ZERO}) AND NOT {_NOM} AND self_health < 0.5 AND self_health >= 0.3", "'margin under half its reference'"), (f"NOT ({_ZERO}) AND NOT {_NOM} AND relative_health_pp < -10", "'margin far under its group'"),
    ("order_cv IS NULL", "'order volatility unknown'"), ("low_volume = 'pulse'", "'pulse shipping'"), ("slope_short", "'too few months for a trend'"), ("self_health < 0.3", "'margin severely worse than history'"), ("pareto = 'key'", "'key product: keep improving cost'"),
    ("pareto = 'regular' AND growth > 1.0", "'fast growing regular product: invest'"), ("joint_diagnosis = 'price_war'", "'price and margin fall together'"), ("consecutive_falls BETWEEN 2 AND 3", "'volume fell ' || consecutive_falls || ' months in a row'"),
    ("growth_clamped", "'growth beyond the clip limit'"), ("decay_cap_removed", "'turned to real decline after a burst'"), ("(contains(strategy, 'exit') OR contains(strategy, 'replacement')) AND rev_profit = 'revenue_down_margin_up'", "'margin recovers: check the exit decision'"),
    ("portrait = 'decline' AND margin_yoy_pp > 5", "'margin rebound: may be deliberate contraction'"),
]
query("r30_product_notes", f"SELECT product_id, portrait, CASE WHEN branch = 'normal' THEN coalesce(nullif(concat_ws('; ', {', '.join(f'CASE WHEN {a} THEN {b} END' for a, b in _NOTES)}), ''), 'no signal') END AS notes FROM pp WHERE as_of = {LM}")(lambda w: w.product_portrait().select("product_id", "portrait", "notes"))

_OLD = """SELECT product_id, CASE WHEN zero_profit THEN 80 WHEN slope_ratio >= 0 THEN 10 WHEN slope_ratio > -0.003 THEN 20 WHEN slope_ratio > -0.008 THEN 50 ELSE 80 END AS old_slope,
  CASE WHEN order_cv IS NULL THEN 85 WHEN order_cv < 0.5 THEN 10 WHEN order_cv < 1 THEN 40 WHEN order_cv < 1.5 THEN 65 ELSE 85 END AS old_cv,
  CASE WHEN yoy_3m > 0.5 THEN CASE WHEN decay_pp <= 0 THEN 10 WHEN decay_pp <= 10 THEN 30 ELSE 50 END WHEN yoy_3m <= -0.1 THEN CASE WHEN decay_pp <= -10 THEN 80 WHEN decay_pp <= 0 THEN 70 WHEN decay_pp <= 10 THEN 60 ELSE 50 END
    WHEN decay_pp < -10 THEN 70 WHEN decay_pp < 0 THEN 50 ELSE 20 END AS old_decay,
  CASE WHEN self_health*100 >= 70 THEN 10 WHEN self_health*100 >= 50 THEN 40 WHEN self_health*100 >= 30 THEN 70 ELSE 90 END AS old_health,
  CASE WHEN asp_slope >= 0 THEN 10 WHEN asp_slope > -0.005 THEN CASE WHEN slope_ratio <= -0.003 THEN 50 ELSE 20 END WHEN asp_slope > -0.01 THEN CASE WHEN slope_ratio > -0.003 THEN 20 ELSE 50 END ELSE 80 END AS old_asp
  FROM pp WHERE as_of = """ + LM


@query("r62_earlier_risk_factors", _OLD)
def _r62(w):
    p = w.product_portrait()
    return p.select(
        "product_id", ops.old_slope(F.col("slope_ratio"), F.col("zero_profit")).alias("old_slope"), ops.old_cv(F.col("order_cv")).alias("old_cv"),
        ops.old_decay(F.col("decay_pp"), F.col("yoy_3m")).alias("old_decay"), ops.old_self_health(F.col("self_health")).alias("old_health"),
        ops.old_asp(F.col("asp_slope"), F.col("slope_ratio")).alias("old_asp"),
    )


# --- single rules over the portrait --------------------------------------------------------------------------
_pick("r07_momentum_class", "growth, momentum", "growth")
_pick("r08_health_class", "self_health, relative_health_pp, health", "self_health relative_health_pp")
_pick("r09_slope_class", "slope_ratio, slope_level", "slope_ratio")
_pick("r11_contextual_strategy", "portrait, margin_yoy_pp, rev_profit, strategy", "margin_yoy_pp")
_pick("r21_slope_score", "slope_ratio, s_slope", "slope_ratio")
_pick("r22_decay_score", "decay_pp, yoy_3m, consecutive_falls, s_decay", "decay_pp yoy_3m")
_pick("r23_health_score", "self_health, s_health", "self_health")
_pick("r25_composite_risk", "s_slope, s_decay, s_health, risk_score, risk_level", "risk_score")


def _order_change(w):
    from ..operators import evaluate

    return evaluate.customer_factors(w.customer_product_month(months=12), [w.latest]).select("product_id", "order_qty_change")


_OC = f"""SELECT product_id, (q1/nullif(m1,0))/nullif(q0/nullif(m0,0),0) - 1 AS order_qty_change FROM (SELECT product_id, coalesce(CAST(sum(qty) FILTER (WHERE month_idx > {LM} - 6) AS DOUBLE), 0) AS q1, coalesce(CAST(sum(qty) FILTER (WHERE month_idx <= {LM} - 6) AS DOUBLE), 0) AS q0,
  CAST(count(*) FILTER (WHERE month_idx > {LM} - 6) AS DOUBLE) AS m1, CAST(count(*) FILTER (WHERE month_idx <= {LM} - 6) AS DOUBLE) AS m0 FROM cpm WHERE month_idx > {LM} - 12 GROUP BY 1)"""
_B6 = "CASE WHEN order_qty_change <= -0.5 THEN 95 WHEN order_qty_change <= -0.2 THEN 75 WHEN order_qty_change <= 0 THEN 50 ELSE 25 END"
query("r24_order_size_score", f"SELECT product_id, order_qty_change, CASE WHEN order_qty_change IS NULL THEN 0 ELSE {_B6} END AS s_order FROM ({_OC})", "order_qty_change")(lambda w: _order_change(w).withColumn("s_order", ops.score_order_change(F.col("order_qty_change"))))
query("r61_order_size_with_availability", f"SELECT product_id, order_qty_change, CASE WHEN order_qty_change IS NOT NULL THEN {_B6} ELSE 30 END AS s_order FROM ({_OC})", "order_qty_change")(
    lambda w: _order_change(w).withColumn("s_order", ops.score_order_change_with_fallback(F.col("order_qty_change"), F.col("order_qty_change").isNotNull(), 30))
)


@query("r64_growth_of_means", f"SELECT product_id, {clip('CASE WHEN p > 0 THEN (coalesce(r, 0) - p)/p ELSE 0 END', -1.0, 5.0)} AS growth FROM (SELECT product_id, CAST(sum(qty) FILTER (WHERE month_idx > {LM} - 6) AS DOUBLE)/nullif(count(*) FILTER (WHERE month_idx > {LM} - 6), 0) AS r, CAST(sum(qty) FILTER (WHERE month_idx <= {LM} - 6 AND month_idx > {LM} - 12) AS DOUBLE)/nullif(count(*) FILTER (WHERE month_idx <= {LM} - 6 AND month_idx > {LM} - 12), 0) AS p FROM pm GROUP BY 1)", "growth")
def _r64(w):
    from ..functions.core import clip as clipped, mean_if, within

    g = w.product_month().groupBy("product_id").agg(mean_if(within(w.latest, 6), "qty").alias("r"), mean_if(within(w.latest, 6, 6), "qty").alias("p"))
    return g.select("product_id", clipped(F.when(F.col("p") > 0, (F.coalesce("r", F.lit(0.0)) - F.col("p")) / F.nullif(F.col("p"), F.lit(0.0))).otherwise(0.0), -1.0, 5.0).alias("growth"))
