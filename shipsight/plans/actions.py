"""Anomalies, actions and risk signals."""

from pyspark.sql import functions as F

from ..operators import actions as ops
from ..operators import anomaly, bridge, customer, insights, pricing, risk, trend
from .registry import cte, query
from .sqlbits import LM, clip, cnt, d, ratio, tot, win

_A = "SELECT * FROM "


def _num(x, n=0):
    return f"printf('%.{n}f', CAST({x} AS DOUBLE) + 0.00000137)"


cte("x_an1", f"SELECT customer_id, 'purchase_interruption' AS anomaly, CASE WHEN revenue_12m > med THEN 'high' ELSE 'medium' END AS level, 'days=' || {_num('l')} || ' interval=' || {_num('g')} AS detail FROM (SELECT customer_id, revenue_12m, coalesce(days_since, 0) AS l, coalesce(interval_days, 60) AS g FROM portrait), (SELECT quantile_cont(revenue_12m, 0.5) AS med FROM portrait) WHERE g > 0 AND l/g > 2")
cte("x_an2", f"SELECT customer_id, 'revenue_cliff' AS anomaly, CASE WHEN growth <= -0.8 THEN 'high' ELSE 'medium' END AS level, 'revenue=' || {_num('revenue_12m')} || ' growth=' || {_num('growth*100')} || '% months=' || streak_down AS detail FROM portrait WHERE revenue_12m > 0 AND growth <= -0.5 AND streak_down >= 2")
cte("x_an3", f"SELECT customer_id, 'price_anomaly' AS anomaly, 'medium' AS level, 'asp=' || {_num('a3', 2)} || ' before=' || {_num('a12', 2)} AS detail FROM (SELECT customer_id, CASE WHEN q3 > 0 THEN r3/q3 ELSE 0 END AS a3, CASE WHEN q12 > 0 THEN r12/q12 ELSE 0 END AS a12 FROM (SELECT customer_id, {tot('revenue', win(3))} AS r3, {tot('qty', win(3))} AS q3, {tot('revenue', win(12, 3))} AS r12, {tot('qty', win(12, 3))} AS q12 FROM cm GROUP BY 1)) WHERE a3 > 0 AND a12 > 0 AND abs((a3-a12)/a12) > 0.3")
_CONC = "SELECT customer_id, 'concentration' AS anomaly, CASE WHEN lifecycle IN ('decline','sleep','lost') THEN 'high' ELSE 'medium' END AS level, 'top1=' || " + _num("top1_share*100") + " || '% stage=' || lifecycle AS detail FROM portrait WHERE top1_share > {}"
cte("x_an4", _CONC.format(0.8))
cte("x_an5", f"SELECT customer_id, 'stagnant_stock' AS anomaly, CASE WHEN stagnant_share > 0.3 THEN 'medium' ELSE 'low' END AS level, 'stagnant=' || {_num('stagnant_share*100', 1)} || '% over_1y=' || {_num('dead_share*100', 1)} || '%' AS detail FROM x_invrisk WHERE stagnant_share > 0.3 OR dead_share > 0.1")
cte("x_log", "SELECT * FROM x_an1 UNION ALL SELECT * FROM x_an2 UNION ALL SELECT * FROM x_an3 UNION ALL SELECT * FROM x_an4 UNION ALL SELECT * FROM x_an5")


def _inv(s):
    return insights.customer_inventory_risk(s.customer_product_month(), insights.estimate_aging(s.product_month(), s.latest))


def _log(s):
    from ..functions.settle import settle

    return settle(anomaly.detect_all(s.portrait(), s.customer_month(), _inv(s), s.latest))


query("r34_purchase_interruption", _A + "x_an1")(lambda w: anomaly.purchase_interruption(w.stored.portrait()))
query("r35_revenue_cliff", _A + "x_an2")(lambda w: anomaly.revenue_cliff(w.stored.portrait()))
query("r36_price_anomaly", _A + "x_an3")(lambda w: anomaly.price_anomaly(w.customer_month(months=15), w.latest))
query("r37_concentration_risk", _CONC.format(0.15))(lambda w: anomaly.concentration_risk(w.stored.portrait(), limit=0.15))
query("r38_stagnant_stock", _A + "x_an5")(lambda w: anomaly.stagnant_stock(_inv(w.stored)))
query("r39_dead_stock", f"SELECT product_id, 'dead_stock' AS anomaly, 'high' AS level, over_1y, stock, monthly FROM (SELECT a.*, coalesce(m, 0) AS monthly FROM x_aging a LEFT JOIN (SELECT product_id, {d('sum(qty)')}/3 AS m FROM pm WHERE {win(3)} GROUP BY 1) USING (product_id)) WHERE over_1y > 0 AND stock > 0 AND monthly < over_1y*3", "over_1y stock monthly")(
    lambda w: anomaly.dead_stock(insights.estimate_aging(w.product_month(months=12), w.latest), w.product_month(months=3), w.latest, ratio=3.0)
)
query("r40_anomaly_union", "SELECT *, CASE level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS severity_rank FROM x_log")(lambda w: _log(w.stored))
query("k07_detector_union", "SELECT anomaly, level, count(*) AS n FROM x_log GROUP BY 1, 2")(lambda w: _log(w.stored).groupBy("anomaly", "level").agg(F.count("*").alias("n")))


@query("r41_isolation_forest")
def _r41(w):
    s = w.stored
    from ..operators import behaviour

    return anomaly.isolation_forest(s.portrait().join(behaviour.volatility(s.customer_month()), "customer_id"))


_ACT = (
    ("new_share < 0.05 AND products > 0", "introduce new products"), ("new_share > 0.2", "expand new products"), ("interrupted", "unusual purchase interval: call back"), ("dependent", "too concentrated: widen the range"),
    ("lifecycle IN ('decline','sleep','lost')", "start recovery or limit credit"), ("lost_share > 0.15", "key products lost: ask for the substitute"), ("low_share > 0.5", "mostly low-price products: room to raise"), ("main_sku_stage = 'exit'", "migrate from exit products"),
)
query("r42_simple_actions", "SELECT customer_id, coalesce(nullif(concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in _ACT) + "), ''), 'no action') AS actions, CAST(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _ in _ACT) + " AS INT) AS action_count FROM portrait")(lambda w: ops.simple_actions(w.stored.portrait()))

query("r48_active_percentiles", " UNION ALL ".join(f"SELECT '{c}' AS measure, " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {n / 100}) AS p{n}" for n in ops.PERCENTILES) + f" FROM sp WHERE revenue_12m > 0" for c in ops.PERCENTILE_COLUMNS), " ".join(f"p{n}" for n in ops.PERCENTILES))(lambda w: ops.active_percentiles(w.scored_portrait()))


def _strategies(s):
    from ..functions.settle import settle

    return settle(ops.strategies(s.scored_portrait(), s.customer_month(), insights.declining_products(s.customer_product_month())))


def _q(c, n):
    return f"(SELECT quantile_cont(CAST({c} AS DOUBLE), {n / 100}) FROM sp WHERE revenue_12m > 0)"


_KA = "tier IN ('KA','AA')"
_REV = f"revenue_12m >= {_q('revenue_12m', 50)}"
_SEV = f"(((journey = 'decline' OR lifecycle = 'decline') AND streak_down >= 3 AND (CASE WHEN revenue_12m > 0 THEN coalesce(dl, 0)/revenue_12m ELSE 0 END) >= 0.3) OR (true_margin <= 0 AND {_REV} AND streak_down >= 2) OR (top3_share >= 0.95 AND {_REV} AND streak_down >= 3))"
_LATE = "(interrupted OR (gap > 0 AND coalesce(days_since, 0) > gap*{}))".format
_MED = f"(streak_down >= 3 OR (zero_share >= 0.9 AND revenue_cv >= CASE WHEN {_KA} THEN 4 WHEN tier = 'KM' THEN 3.5 ELSE 5 END) OR ({_LATE(2.0)} AND {_REV} AND journey <> 'lost'))"
_HIGH = f"profit_12m >= {_q('profit_12m', 50)}"
_DOWN = "(lifecycle IN ('decline','lost') OR journey IN ('decline','lost'))"
_G70 = f"growing_score >= {_q('growing_score', 70)}"
cte(
    "x_str",
    f"""SELECT *, CASE WHEN activity = 'inactive' OR value_tier = 'dormant' THEN 'dormant' WHEN risk_control_level = 'watch_upgrade' THEN 'watch_upgrade' WHEN risk_control_level IS NOT NULL THEN 'risk_control'
      WHEN NOT (value_tier IN ('S','A') AND revenue_12m > 0) AND (journey IN ('lost','reactivated') OR lifecycle IN ('sleep','lost') OR (coalesce(days_since, 0) > 180 AND revenue_prior_12m >= 20000)) AND revenue_prior_12m >= 20000 THEN 'reactivate'
      WHEN s1 AND (bonuses >= 2 OR {_KA}) THEN 'deep_binding' WHEN s1 THEN 'key_upkeep'
      WHEN top3_share < 0.95 AND NOT {_DOWN} AND trading_months >= 3 AND (streak_up >= 3 OR (value_tier IN ('B','C') AND {_G70}) OR (coalesce(new_share, 0) > 0.15 AND revenue_12m >= {_q('revenue_12m', 20)}) OR (growth > 0.1 AND {_G70}) OR (journey = 'growth' AND growing_score >= {_q('growing_score', 65)})) THEN 'growth'
      WHEN NOT {_DOWN} AND streak_down < 2 AND NOT (categories >= {_q('categories', 50)} AND {_q('categories', 50)} > 0) AND category_label IS NOT NULL AND revenue_12m >= 5000 AND (trading_months >= 3 OR value_tier IN ('A','B')) THEN 'category'
      WHEN value_tier IN ('S','A') THEN 'key_upkeep' WHEN value_tier = 'B' THEN 'silent_upkeep' ELSE 'silent_watch' END AS strategy FROM (
      SELECT *, CASE WHEN lv IS NOT NULL AND value_tier IN ('S','A') AND NOT {_KA} THEN 'watch_upgrade' ELSE lv END AS risk_control_level, value_tier IN ('S','A') AND trading_months >= 12 AND profit_12m >= CASE WHEN {_KA} THEN {_q('profit_12m', 50)} ELSE {_q('profit_12m', 70)} END AS s1,
        CAST(growing_score >= {_q('growing_score', 50)} AS INT) + CAST(categories >= {_q('categories', 75)} AND {_q('categories', 75)} > 0 AS INT) + CAST(top3_share < 0.6 AS INT) + CAST(journey = 'mature' AS INT) AS bonuses FROM (
        SELECT *, CASE WHEN profit_12m < {_q('profit_12m', 15)} THEN NULL WHEN {_HIGH} AND {_SEV} THEN 'severe' WHEN {_HIGH} AND {_MED} THEN 'medium' WHEN {_HIGH} AND {_LATE(1.5)} THEN 'light' WHEN NOT {_HIGH} AND {_SEV} THEN 'severe' END AS lv FROM (
          SELECT sp.*, coalesce(interval_days, 60) AS gap, coalesce(trading_months, 0) AS trading_months, dl FROM sp LEFT JOIN (SELECT customer_id, count(DISTINCT month_idx) AS trading_months FROM cm WHERE revenue > 0 GROUP BY 1) USING (customer_id)
          LEFT JOIN (SELECT customer_id, sum(loss) AS dl FROM x_decl WHERE rank <= 5 GROUP BY 1) USING (customer_id))))""",
)
cte("x_strategy", "SELECT *, CASE WHEN strategy IN ('risk_control','watch_upgrade') THEN risk_control_level WHEN strategy = 'reactivate' AND streak_down >= 3 THEN 'weak' WHEN strategy = 'reactivate' THEN 'advised' END AS strategy_level FROM x_str")
_SC = "customer_id, strategy, strategy_level, bonuses, trading_months, risk_control_level"
query("r43_strategy_rules", f"SELECT {_SC} FROM x_strategy")(lambda w: _strategies(w.stored).select(*[x.strip() for x in _SC.split(",")]))
for _n, _cond in (("r44_risk_control", "strategy IN ('risk_control', 'watch_upgrade')"), ("r45_reactivation", "strategy = 'reactivate'"), ("r46_deep_binding", "strategy = 'deep_binding'"), ("r47_growth_and_category", "strategy IN ('growth', 'category')")):
    query(_n, f"SELECT {_SC} FROM x_strategy WHERE {_cond}")(lambda w, c=_cond: _strategies(w.stored).filter(c).select(*[x.strip() for x in _SC.split(",")]))

cte(
    "x_alert",
    """SELECT customer_id, count(*) AS alerts, string_agg(m, '; ' ORDER BY m) AS messages, max(owner) AS owner FROM (SELECT customer_id, owner, CASE WHEN level = 'high' AND pri <= 2 THEN '[urgent] ' || anomaly || ': ' || detail WHEN level = 'high' THEN '[watch] ' || anomaly WHEN level = 'medium' AND pri <= 2 THEN '[note] ' || anomaly || ': ' || detail END AS m
      FROM x_log JOIN (SELECT customer_id, owner, CASE WHEN activity = 'inactive' OR value_tier = 'dormant' THEN 5 WHEN value_tier = 'S' OR tier IN ('KA','AA') THEN 1 WHEN value_tier = 'A' THEN 2 WHEN value_tier = 'B' THEN 3 ELSE 4 END AS pri FROM sp) USING (customer_id)
      WHERE pri < 4 AND (anomaly <> 'revenue_cliff' OR pri <= 2)) WHERE m IS NOT NULL GROUP BY 1""",
)
query("r49_alerts", _A + "x_alert")(lambda w: ops.alerts(_log(w.stored), w.scored_portrait()))


@query("r63_action_table", "SELECT customer_id, strategy, strategy_level, coalesce(alerts, 0) AS alerts, messages, best_revenue, best_product, product_id AS worst_product, change_pct AS worst_change FROM x_strategy LEFT JOIN x_alert USING (customer_id) LEFT JOIN x_glory USING (customer_id) LEFT JOIN (SELECT customer_id, product_id, change_pct FROM x_decl WHERE rank = 1) USING (customer_id)", "best_revenue worst_change")
def _r63(w):
    s = w.stored
    return ops.action_table(_strategies(s), ops.alerts(_log(s), s.scored_portrait()), insights.best_window(s.customer_month(), s.customer_product_month()), insights.declining_products(s.customer_product_month()))


# --- risk signals --------------------------------------------------------------------------------------------
_PREVM = f"({LM} - 1)"


def _sig(entity, kind, level, loss, channel, src):
    return f"SELECT CAST({entity} AS VARCHAR) AS entity, {kind} AS kind, {level} AS level, CAST({loss} AS DOUBLE) AS loss, '{channel}' AS channel FROM {src}"


cte(
    "x_sig",
    " UNION ALL ".join([
        _sig("customer_id", "anomaly", "level", "0", "anomaly_log", "x_log WHERE level IN ('high','medium')"),
        _sig("customer_id", "'negative_margin'", "CASE severity WHEN 'severe' THEN 'high' WHEN 'watch' THEN 'medium' WHEN 'slight' THEN 'low' ELSE 'medium' END", "abs(loss)", "negative_margin", "x_neg WHERE loss_products > 0 AND loss <= -10000"),
        _sig("customer_id", "CASE WHEN mom <= -50 THEN 'revenue_cliff' ELSE 'new_import' END", "CASE WHEN mom <= -50 THEN 'high' ELSE 'medium' END", "CASE WHEN mom <= -50 THEN greatest(CASE WHEN mom > -100 THEN revenue/(1+mom/100) ELSE 0 END - revenue, 0) ELSE 0 END", "revenue_shock", f"x_trend WHERE month_idx = {_PREVM} AND revenue >= 50000 AND (mom <= -50 OR mom >= 50)"),
        _sig("customer_id", "'purchase_interruption'", "CASE WHEN days_since >= 120 THEN 'high' ELSE 'medium' END", "0", "purchase_interruption", "portrait WHERE interrupted AND revenue_12m >= 0"),
        _sig("customer_id", "'margin_drop'", "CASE WHEN -margin_change_pct >= 15 THEN 'high' ELSE 'medium' END", "0", "margin_deterioration", "portrait WHERE -margin_change_pct >= 5 AND revenue_12m >= 100000"),
        _sig("customer_id", "'decline_risk'", "CASE WHEN s >= 0.5 THEN 'high' ELSE 'medium' END", "0", "decline_risk", f"(SELECT customer_id, CASE WHEN sum(revenue) > 0 THEN {tot('revenue', chr(39).join(['portrait IN (', 'warning_growth', ',', 'hidden_decline', ',', 'decline', ')']))}/{d('sum(revenue)')} ELSE 0 END AS s FROM x_bridge GROUP BY 1) WHERE s >= 0.3"),
        _sig("product_id", "'high_risk_product'", "CASE WHEN risk_level = 'very_high' THEN 'high' ELSE 'medium' END", "0", "high_risk_product", f"pp WHERE as_of = {LM} AND risk_level IN ('high','very_high') AND r12_r >= 200000"),
        _sig("customer_id", "'pricing_anomaly'", "CASE WHEN (price-p50)/p50*100 <= -20 THEN 'high' ELSE 'medium' END", "0", "pricing_anomaly", "x_fair WHERE low_price_anomaly AND p50 > 0 AND abs((price-p50)/p50*100) >= 10"),
    ]),
)


def _signals(w):
    from ..functions.core import union_all
    from ..functions.settle import settle

    s = w.stored
    cpm, p = s.customer_product_month(), s.portrait()
    products = settle(w.product_portrait())
    return settle(union_all([
        risk.channel_anomaly(_log(s)), risk.channel_negative_margin(insights.negative_margin(cpm, p)), risk.channel_revenue_shock(trend.revenue_trend(s.customer_month()), w.latest - 1, min_revenue=50_000),
        risk.channel_interruption(p), risk.channel_margin_drop(p, min_revenue=100_000), risk.channel_decline_risk(bridge.portfolio_health(bridge.customer_product_bridge(cpm, products))), risk.channel_risky_product(products),
        risk.channel_pricing(pricing.pricing_fairness(cpm, s.customers("channel", "tier"))),
    ]))


query("r50_risk_channels", _A + "x_sig", "loss")(_signals)
_RK = "CASE level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 9 END"


def _merged(src: str) -> str:
    return f"SELECT entity, CASE r WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'other' END AS level, loss, signals, kinds FROM (SELECT entity, min(r) AS r, max(loss) AS loss, CAST(sum(n) AS BIGINT) AS signals, list(kind ORDER BY r, loss DESC, kind) AS kinds FROM (SELECT entity, kind, min({_RK}) AS r, max(loss) AS loss, count(*) AS n FROM {src} GROUP BY 1, 2) GROUP BY 1)"


cte("x_merged", _merged("x_sig"))


def _join(df):
    return df.withColumn("kinds", F.array_join("kinds", ", "))


query("r51_signal_merge", "SELECT * REPLACE (array_to_string(kinds, ', ') AS kinds) FROM x_merged", "loss")(lambda w: _join(risk.merge_signals(_signals(w))))
query("r65_ranked_risks", "SELECT entity, level, loss, signals, array_to_string(kinds, ', ') AS kinds, rank, CASE WHEN rank <= 10 THEN 'listed' ELSE 'overflow' END AS part FROM (SELECT *, row_number() OVER (ORDER BY " + _RK + ", loss DESC, entity) AS rank FROM x_merged)", "loss")(lambda w: risk.ranked_list(risk.merge_signals(_signals(w))))


def _back(m: str) -> str:
    g = f"(SELECT *, CASE WHEN p > 0 THEN (r-p)/p*100 END AS mom FROM (SELECT customer_id, {tot('revenue', f'month_idx = {m}')} AS r, {tot('revenue', f'month_idx = {m} - 1')} AS p, {tot('profit', f'month_idx = {m}')} AS m FROM cm WHERE month_idx BETWEEN {m} - 1 AND {m} GROUP BY 1))"
    return " UNION ALL ".join([_sig("customer_id", "'revenue_cliff'", "'high'", "p - r", "revenue_shock", f"{g} WHERE p >= 50000 AND mom <= -50"), _sig("customer_id", "'new_import'", "'medium'", "0", "revenue_shock", f"{g} WHERE r >= 50000 AND mom >= 50"), _sig("customer_id", "'negative_margin'", "'medium'", "-m", "negative_margin", f"{g} WHERE m <= -2000")])


def _bf(w, back):
    return risk.backfill_signals(w.customer_month(), w.latest - back, min_revenue=50_000, min_loss=2_000)


query("r53_signal_backfill", _back(_PREVM), "loss")(lambda w: _bf(w, 1))
_CH = """CASE WHEN p.loss > 0 AND c.loss > 0 AND c.loss > p.loss*1.1 AND c.loss - p.loss >= 10000 THEN 'worse' WHEN p.loss > 0 AND c.loss > 0 AND c.loss < p.loss*0.9 AND p.loss - c.loss >= 10000 THEN 'better' WHEN cr < pr THEN 'worse' WHEN cr > pr THEN 'better' ELSE 'equal' END"""
_MM = f"""WITH c AS (SELECT *, {_RK} AS cr FROM ({_merged(f'({_back(_PREVM)})')})), p AS (SELECT *, {_RK} AS pr, 1 AS months FROM ({_merged(f'({_back(f"({LM} - 2)")})')}))"""
_STATE = f"""{_MM} SELECT c.entity, CASE WHEN hit THEN 'continuing' ELSE 'new' END AS state, CASE WHEN hit THEN 2 ELSE 0 END AS months, c.level, c.loss, CASE WHEN hit THEN ch END AS change, array_to_string(c.kinds, ', ') AS kinds FROM c LEFT JOIN (SELECT c.entity, list_has_any(c.kinds, p.kinds) AS hit, {_CH} AS ch FROM c JOIN p USING (entity)) h USING (entity)
  UNION ALL SELECT p.entity, 'released', months, p.level, p.loss, NULL, array_to_string(p.kinds, ', ') FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.entity = p.entity AND list_has_any(c.kinds, p.kinds))"""


def _states(w):
    prev = risk.merge_signals(_bf(w, 2)).withColumn("months", F.lit(1))
    return risk.month_over_month(risk.merge_signals(_bf(w, 1)), prev)


query("r52_month_over_month_risk", _STATE, "loss")(lambda w: _join(_states(w)))
query("r66_change_class", f"SELECT entity, change FROM ({_STATE}) WHERE change IS NOT NULL")(lambda w: _states(w).filter("change IS NOT NULL").select("entity", "change"))
query("s_text_detail_numbers", "SELECT customer_id, anomaly, CAST(nullif(regexp_extract(detail, 'revenue=(-?[0-9.,]+)', 1), '') AS DOUBLE) AS d_revenue, CAST(nullif(regexp_extract(detail, 'growth=(-?[0-9.]+)%', 1), '') AS DOUBLE) AS d_growth, CAST(nullif(regexp_extract(detail, 'months=([0-9]+)', 1), '') AS INT) AS d_months FROM x_an2", "d_revenue d_growth")(
    lambda w: risk.parse_detail(anomaly.revenue_cliff(w.stored.portrait())).select("customer_id", "anomaly", "d_revenue", "d_growth", "d_months")
)
