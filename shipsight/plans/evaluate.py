"""Score evaluation, group aggregation, addresses, master-data match, sources."""

from pyspark.sql import functions as F

from ..functions.core import dbl
from ..functions.settle import settle
from ..operators import evaluate as ops
from ..operators import grouping, product, trend
from ..operators.trend import two_month_label
from .quality import panel
from .registry import cte, query
from .sqlbits import LM, cnt, d, ratio, tot, win

cte("x_lab", "SELECT product_id, month_idx, CASE WHEN l > 0 THEN CASE WHEN coalesce(n, 0)/61.0 < l/183.0*0.8 THEN 1 ELSE 0 END END AS label FROM (SELECT product_id, month_idx, sum(qty) OVER (PARTITION BY product_id ORDER BY month_idx RANGE BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS n, sum(qty) OVER (PARTITION BY product_id ORDER BY month_idx RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS l FROM x_panel)")
cte("ev", f"SELECT p.product_id, p.as_of, s_slope, s_decay, s_health, risk_score, risk_level, order_cv, top1, label FROM pp p JOIN x_lab ON x_lab.product_id = p.product_id AND month_idx = as_of WHERE branch = 'normal' AND label IS NOT NULL AND as_of <= {LM} - 3 AND as_of >= {LM} - 14")


def samples(w):
    """Supervised samples: portrait factors at past cut-offs with the two-month decline label."""
    p = w.product_portrait(range(3, 15)).filter(F.col("branch") == "normal").select("product_id", "as_of", "s_slope", "s_decay", "s_health", "risk_score", "risk_level", "order_cv", "top1")
    lab = two_month_label(panel(w)).filter(F.col("label").isNotNull()).withColumnRenamed("month_idx", "as_of")
    return settle(p.join(lab, ["product_id", "as_of"]))


_E = "risk_score order_cv top1"
query("r71_supervised_samples", "SELECT * FROM ev", _E)(samples)
_AUC = "SELECT {k} (sum(label*r) - sum(label)*(sum(label)+1)/2.0)/(sum(label)*(count(*)-sum(label))) AS auc, count(*) AS samples, CAST(sum(label) AS BIGINT) AS positives FROM (SELECT *, rank() OVER ({p} ORDER BY risk_score) + (count(*) OVER (PARTITION BY {q} risk_score) - 1)/2.0 AS r FROM {src}) {g}"
_AUC1 = _AUC.format(k="", p="", q="", src="ev", g="")
_CONF = f"SELECT *, p AS precision, r AS recall, 2*p*r/nullif(p+r,0) AS f1, 5*p*r/nullif(4*p+r,0) AS f2, tn/nullif({d('tn')}+fp,0) AS specificity, {d('fp')}/(tp+fp+fn+tn)*1000 AS false_per_1000 FROM (SELECT *, {d('tp')}/nullif(tp+fp,0) AS p, {d('tp')}/nullif(tp+fn,0) AS r FROM (SELECT {cnt('risk_score > 55 AND label = 1')} AS tp, {cnt('risk_score > 55 AND label = 0')} AS fp, {cnt('risk_score <= 55 AND label = 1')} AS fn, {cnt('risk_score <= 55 AND label = 0')} AS tn FROM ev))"
query("r55_classification_metrics", f"SELECT a.*, tp, fp, fn, tn, precision, recall, f1, f2, specificity, false_per_1000 FROM ({_AUC1}) a, ({_CONF})", "auc precision recall f1 f2 specificity false_per_1000")(lambda w: ops.classification_metrics(samples(w), "risk_score", 55.0))
query("r55_level_rates", "SELECT risk_level, n, rate, coalesce(rate >= lag(rate) OVER (ORDER BY o), TRUE) AS monotone FROM (SELECT risk_level, count(*) AS n, avg(label) AS rate, CASE risk_level WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END AS o FROM ev GROUP BY 1)", "rate")(lambda w: ops.level_rates(samples(w), "risk_level", {"low": 0, "medium": 1, "high": 2, "very_high": 3}))
from .scoring import _qcut  # noqa: E402

query("r56_score_buckets", "SELECT bucket, count(*) AS n, avg(label) AS rate, avg(order_cv) AS mean_value FROM (SELECT * FROM (SELECT product_id || '-' || as_of AS k, label, order_cv FROM ev WHERE order_cv IS NOT NULL) JOIN " + _qcut("(SELECT product_id || '-' || as_of AS k, order_cv FROM ev)", "k", "order_cv", None, True, False, "bucket") + " USING (k)) GROUP BY 1", "rate mean_value")(lambda w: ops.score_buckets(samples(w), "order_cv"))
_GW = ops.weight_grid(3, 5)
cte("x_grid", "SELECT CAST(unnest([" + ", ".join(str(i) for i in range(len(_GW))) + "]) AS INT) AS combo, " + ", ".join(f"CAST(unnest([{', '.join(str(g[j]) for g in _GW)}]) AS DOUBLE) AS w{j}" for j in range(3)))
cte("x_gs", """SELECT combo, any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2, (sum(label*r) - sum(label)*(sum(label)+1)/2.0)/(sum(label)*(count(*)-sum(label))) AS auc, CAST(count(*) FILTER (WHERE score > 55 AND label = 1) AS DOUBLE)/nullif(count(*) FILTER (WHERE score > 55), 0) AS precision,
  CAST(count(*) FILTER (WHERE score > 55 AND label = 1) AS DOUBLE)/nullif(count(*) FILTER (WHERE label = 1), 0) AS recall FROM (SELECT *, rank() OVER (PARTITION BY combo ORDER BY score) + (count(*) OVER (PARTITION BY combo, score) - 1)/2.0 AS r FROM (SELECT combo, w0, w1, w2, label, round(s_slope*w0 + s_decay*w1 + s_health*w2, 8) AS score FROM ev CROSS JOIN x_grid)) GROUP BY 1""")
query("r57_weight_grid", "SELECT * FROM x_gs", "w0 w1 w2 auc precision recall")(lambda w: ops.grid_search(samples(w), ["s_slope", "s_decay", "s_health"], step=5))
_LV = "CASE WHEN risk_score <= low THEN 0 WHEN risk_score <= mid THEN 1 WHEN risk_score <= high THEN 2 ELSE 3 END"
query("r58_threshold_search", f"""SELECT low, mid, high, r0, r1, r2, r3, (r3 - r0)*0.6 + ((r1 >= r0)::INT + (r2 >= r1)::INT + (r3 >= r2)::INT)/3.0*0.4 AS objective FROM (SELECT low, mid, high, {', '.join(f'coalesce(avg(label) FILTER (WHERE lv = {k}), 0) AS r{k}' for k in range(4))} FROM (SELECT *, {_LV} AS lv FROM ev
  CROSS JOIN (SELECT a.c AS low, b.c AS mid, e.c AS high FROM (SELECT CAST(unnest(range(30, 80, 10)) AS INT) AS c) a, (SELECT CAST(unnest(range(30, 80, 10)) AS INT) AS c) b, (SELECT CAST(unnest(range(30, 80, 10)) AS INT) AS c) e WHERE a.c < b.c AND b.c < e.c)) GROUP BY 1, 2, 3)""", "r0 r1 r2 r3 objective")(lambda w: ops.threshold_search(samples(w)))
_FOLD = "(SELECT ev.*, CAST(floor(b*4.0/n) AS INT) AS fold FROM ev JOIN (SELECT as_of, row_number() OVER (ORDER BY as_of DESC) - 1 AS b, count(*) OVER () AS n FROM (SELECT DISTINCT as_of FROM ev)) USING (as_of) WHERE floor(b*4.0/n) < 3)"
query("r59_time_series_cv", _AUC.format(k="fold,", p="PARTITION BY fold", q="fold,", src=_FOLD, g="GROUP BY fold"), "auc")(lambda w: ops.time_series_cv(samples(w)))
query("r67_coverage", f"SELECT *, {d('caught')}/nullif(declined,0) AS coverage FROM (SELECT {cnt('dd')} AS declined, {cnt('dd AND f')} AS caught FROM (SELECT product_id, bool_or(label = 1) AS dd, bool_or(risk_score > 55) AS f FROM ev GROUP BY 1))", "coverage")(lambda w: ops.coverage(samples(w), F.col("risk_score") > 55))
cte("ev_fold", f"SELECT * FROM {_FOLD}")
_SIDE = "FROM (SELECT fold, risk_score, count(*) AS n, sum(label) AS p FROM ev_fold GROUP BY 1, 2)"
_FAC = ("s_slope", "s_decay", "s_health")
_RANKED = ", ".join(f"rank() OVER (PARTITION BY fold ORDER BY {x}) + (count(*) OVER (PARTITION BY fold, {x}) - 1)/2.0 AS r_{x}" for x in (*_FAC, "risk_score", "order_cv"))
query("r68_fold_ranking", f"""SELECT a.*, average_precision, top_hit_rate, top_hit_rate/base AS top_lift, f2, precision_highest, recall_alarm, {', '.join(f'missing_{x}, auc_{x}' for x in _FAC)}, spearman FROM ({_AUC.format(k="fold,", p="PARTITION BY fold", q="fold,", src="ev_fold", g="GROUP BY fold")}) a
  JOIN (SELECT fold, sum(p*(pb + p)/(nb + n))/max(pt) AS average_precision, {d('sum(p) FILTER (WHERE nb < nt*0.2)')}/sum(n) FILTER (WHERE nb < nt*0.2) AS top_hit_rate, {d('max(pt)')}/max(nt) AS base FROM (SELECT *, coalesce(sum(n) OVER w, 0) AS nb, coalesce(sum(p) OVER w, 0) AS pb, sum(n) OVER (PARTITION BY fold) AS nt, sum(p) OVER (PARTITION BY fold) AS pt {_SIDE} WINDOW w AS (PARTITION BY fold ORDER BY risk_score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY 1) USING (fold)
  JOIN (SELECT fold, CASE WHEN max(CAST(risk_score > 55 AS INT)) > min(CAST(risk_score > 55 AS INT)) AND max(label) > min(label) THEN 5.0*{cnt('risk_score > 55 AND label = 1')}/(5*{cnt('risk_score > 55 AND label = 1')} + 4*{cnt('risk_score <= 55 AND label = 1')} + {cnt('risk_score > 55 AND label = 0')}) END AS f2, avg(label) FILTER (WHERE risk_score > 68) AS precision_highest, {d(cnt('risk_score > 65 AND label = 1'))}/nullif({cnt('label = 1')}, 0) AS recall_alarm, {', '.join(f'avg(CAST({x} IS NULL AS INT)) AS missing_{x}' for x in _FAC)} FROM ev_fold GROUP BY 1) USING (fold)
  JOIN (SELECT fold, {', '.join(f'(sum(label*r_{x}) - sum(label)*(sum(label)+1)/2.0)/nullif(sum(label)*(count(*)-sum(label)), 0) AS auc_{x}' for x in _FAC)} FROM (SELECT *, {_RANKED} FROM ev_fold) GROUP BY 1) USING (fold)
  LEFT JOIN (SELECT fold, corr(r_risk_score, r_order_cv) AS spearman FROM (SELECT *, {_RANKED} FROM ev_fold WHERE order_cv IS NOT NULL) GROUP BY 1) USING (fold)""", "auc average_precision top_hit_rate top_lift f2 precision_highest recall_alarm spearman " + " ".join(f"missing_{x} auc_{x}" for x in _FAC))(lambda w: ops.fold_ranking(samples(w), target="order_cv", factors=_FAC))
query("rank_correlation", f"SELECT as_of, CASE WHEN count(*) >= 5 AND max(ra) > min(ra) AND max(rb) > min(rb) THEN corr(ra, rb) END AS rho FROM (SELECT as_of, rank() OVER (PARTITION BY as_of ORDER BY top1) + (count(*) OVER (PARTITION BY as_of, top1) - 1)/2.0 AS ra, rank() OVER (PARTITION BY as_of ORDER BY order_cv) + (count(*) OVER (PARTITION BY as_of, order_cv) - 1)/2.0 AS rb FROM ev WHERE top1 IS NOT NULL AND order_cv IS NOT NULL) GROUP BY 1", "rho")(lambda w: ops.rank_correlation(samples(w), ["as_of"], "top1", "order_cv"))


cte("ev_weight", "UNPIVOT (SELECT fold, corr(s_slope, label) AS s_slope, corr(s_decay, label) AS s_decay, corr(s_health, label) AS s_health FROM ev_fold GROUP BY 1) ON s_slope, s_decay, s_health INTO NAME factor VALUE w")


@query("r69_fold_stability", """WITH pairs AS (SELECT a.fold, a.factor AS x, b.factor AS y, sign(a.w - b.w) AS s FROM ev_weight a JOIN ev_weight b ON a.fold = b.fold AND a.factor < b.factor)
  SELECT factor, stddev_samp(w)/nullif(avg(w), 0) AS cv, (SELECT avg(p.s*q.s) FROM pairs p JOIN pairs q ON p.x = q.x AND p.y = q.y AND p.fold < q.fold) AS mean_tau FROM ev_weight GROUP BY 1""", "cv mean_tau")
def _r69(w):
    s = settle(ops.time_folds(samples(w)))
    g = s.groupBy("fold").agg(*[F.corr(dbl(f), dbl("label")).alias(f) for f in ("s_slope", "s_decay", "s_health")])
    return ops.fold_stability(settle(g), ["s_slope", "s_decay", "s_health"])


query("r70_factor_hypothesis", "SELECT CASE WHEN order_cv >= 0.8 THEN 'high' ELSE 'low' END AS side, count(*) AS n, avg(label) AS rate FROM ev WHERE order_cv IS NOT NULL GROUP BY 1", "rate")(lambda w: ops.factor_hypothesis(samples(w), "order_cv", 0.8))
query("k10_pareto_frontier", "WITH g AS (SELECT combo, coalesce(auc, 0) AS auc, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall FROM x_gs) SELECT * FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.auc >= a.auc AND b.precision >= a.precision AND b.recall >= a.recall AND (b.auc > a.auc OR b.precision > a.precision OR b.recall > a.recall))", "auc precision recall")(lambda w: ops.pareto_frontier(ops.grid_search(samples(w), ["s_slope", "s_decay", "s_health"], step=5).na.fill(0.0), ["auc", "precision", "recall"], ["combo"]))
query("r54_customer_factors", f"""WITH c AS (SELECT CAST(unnest([{', '.join(f'{LM} - {k}' for k in (1, 4, 7))}]) AS INT) AS as_of), pc AS (SELECT product_id, as_of, customer_id, {tot('revenue', 'as_of - month_idx < 6')} AS r1, {tot('revenue', 'as_of - month_idx >= 6')} AS r0, {tot('qty', 'as_of - month_idx < 6')} AS q1, {tot('qty', 'as_of - month_idx >= 6')} AS q0, {cnt('as_of - month_idx < 6')} AS m1, {cnt('as_of - month_idx >= 6')} AS m0
  FROM cpm JOIN c ON month_idx <= as_of AND month_idx > as_of - 12 GROUP BY 1, 2, 3), g AS (SELECT product_id, as_of, max(r1) AS x1, sum(r1) AS t1, max(r0) AS x0, sum(r0) AS t0, {cnt('m1 > 0 AND m0 = 0')} AS gained, {cnt('m1 = 0 AND m0 > 0')} AS lost, stddev_samp(CASE WHEN q1 > 0 THEN r1/q1 END)/nullif(avg(CASE WHEN q1 > 0 THEN r1/q1 END),0) AS price_cv, sum(q1) AS q1, sum(q0) AS q0, {d('sum(m1)')} AS m1, {d('sum(m0)')} AS m0 FROM pc GROUP BY 1, 2)
  SELECT g.product_id, g.as_of, x1/nullif(t1,0) - x0/nullif(t0,0) AS concentration_change, top5_churn, gained - lost AS net_customers, price_cv, m1/nullif(m0,0) - 1 AS frequency_change, (q1/nullif(m1,0))/nullif(q0/nullif(m0,0),0) - 1 AS order_qty_change FROM g LEFT JOIN (SELECT product_id, as_of, {d(cnt('m1 = 0'))}/count(*) AS top5_churn FROM (SELECT *, row_number() OVER (PARTITION BY product_id, as_of ORDER BY r0 DESC, customer_id) AS rn FROM pc WHERE r0 > 0) WHERE rn <= 5 GROUP BY 1, 2) USING (product_id, as_of)""", "concentration_change top5_churn price_cv frequency_change order_qty_change")(
    lambda w: ops.customer_factors(w.customer_product_month(months=24), [w.latest - k for k in (1, 4, 7)])
)


@query("f44_point_in_time_features", f"SELECT product_id, as_of, growth, margin, top1, top3, age, first_bulk_idx IS NOT NULL AS reached_bulk FROM pp WHERE as_of IN ({LM} - 3, {LM} - 6)", "growth margin top1 top3")
def _f44(w):
    p = w.product_portrait((3, 6))
    return p.select("product_id", "as_of", "growth", "margin", "top1", "top3", "age", F.col("first_bulk_idx").isNotNull().alias("reached_bulk"))


# --- groups, addresses, master data -------------------------------------------------------------------------
def _names(w):
    from ..sources.fact import table

    cust = table(w.spark, w.folder, "customer").select(F.col("c_custkey").alias("customer_id"), F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("c_name")).alias("name"))
    return cust


_KW = {"machine group": ["machin"], "home group": ["house", "furni"]}
cte("x_grp", "SELECT customer_id, CASE WHEN name ILIKE '%machin%' THEN 'machine group' WHEN name ILIKE '%house%' OR name ILIKE '%furni%' THEN 'home group' ELSE CASE WHEN count(*) OVER (PARTITION BY pre) >= 3 THEN pre ELSE '' END END AS group_name FROM (SELECT customer_id, name, CASE WHEN name ILIKE '%machin%' OR name ILIKE '%house%' OR name ILIKE '%furni%' THEN NULL ELSE substr(name, 1, 3) END AS pre FROM (SELECT c_custkey AS customer_id, c_mktsegment || ' ' || c_name AS name FROM customer))")
query("a46_group_identification", "SELECT * FROM x_grp")(lambda w: grouping.identify_groups(_names(w), _KW, prefix=r"^[A-Z]{3}").select("customer_id", "group_name"))


@query("a45_group_aggregation", f"""SELECT group_name, members, revenue, profit, CASE WHEN revenue > 0 THEN profit/revenue*100 ELSE 0 END AS margin, lines, active_members, dormant_members, CASE WHEN dormant_members >= members THEN 'all_stalled' WHEN dormant_members > members*0.5 THEN 'mostly_stalled' ELSE 'normal' END AS risk FROM (
  SELECT group_name, count(*) AS members, sum(revenue_12m) AS revenue, sum(profit_12m) AS profit, {cnt("lifecycle IN ('mature','ramp','intro')")} AS active_members, {cnt("lifecycle IN ('lost','sleep')")} AS dormant_members FROM x_grp JOIN x_mom USING (customer_id) JOIN x_life USING (customer_id) WHERE group_name <> '' GROUP BY 1)
  JOIN (SELECT group_name, count(DISTINCT product_line) AS lines FROM x_grp JOIN cpm USING (customer_id) GROUP BY 1) USING (group_name)""", "revenue profit margin")
def _a45(w):
    from ..operators import customer

    cm = w.customer_month()
    g = grouping.identify_groups(_names(w), _KW, prefix=r"^[A-Z]{3}")
    p = customer.momentum(cm, w.latest).join(customer.customer_lifecycle(cm, w.latest), "customer_id")
    return grouping.aggregate_groups(p, g, w.fact("customer_id", "product_line").distinct())


@query("j11_missing_combinations", "SELECT customer_id, category FROM (SELECT DISTINCT customer_id FROM cpm) CROSS JOIN (SELECT category FROM cpm GROUP BY 1 HAVING CAST(sum(revenue) AS DOUBLE)/(SELECT CAST(sum(revenue) AS DOUBLE) FROM cpm) > 0.1) EXCEPT SELECT customer_id, category FROM cpm")
def _j11(w):
    f = w.fact("customer_id", "category", "revenue")
    return grouping.missing_combinations(f, "customer_id", "category", 0.1)


@query("j12_master_match", "SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 3 = 0 THEN 'full' WHEN c_custkey % 3 = 1 THEN 'short' END AS matched_by, CASE WHEN c_custkey % 3 <> 2 THEN c_mktsegment END AS segment FROM customer")
def _j12(w):
    from ..sources.fact import table

    t = table(w.spark, w.folder, "customer")
    keys = t.select(F.col("c_custkey").alias("customer_id"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.upper("c_name"))).when(F.col("c_custkey") % 3 == 1, F.substring("c_name", 10, 9)).otherwise(F.lit("no such")).alias("name"))
    master = t.select(F.col("c_name").alias("full_name"), F.substring("c_name", 10, 9).alias("short_name"), F.col("c_mktsegment").alias("segment"))
    return grouping.match_master(keys, master, ["segment"]).select("customer_id", "matched_by", "segment")


_NOISY = "CASE s_suppkey % 6 WHEN 0 THEN replace(s_name, 'pp', 'p') WHEN 1 THEN ' ' || upper(s_name) WHEN 2 THEN s_name || ' inc' WHEN 3 THEN 'no such name ' || CAST(s_suppkey AS STRING) WHEN 4 THEN 'Co ' || CAST(s_suppkey*7919 AS STRING) WHEN 5 THEN replace(s_name, '#', '-no-') END"
cte("sup_master", "SELECT lower(s_name || ' trading co') AS f, s_name || ' trading co' AS full_name, lower('co. ' || CAST(s_suppkey*7919 AS VARCHAR)) AS s, 'Co. ' || CAST(s_suppkey*7919 AS VARCHAR) AS short_name FROM supplier")
cte("sup_left", f"SELECT s_suppkey AS supplier_id, lower(trim(CASE WHEN s_suppkey % 6 IN (3, 4) THEN {_NOISY} ELSE {_NOISY} || ' trading co' END)) AS a FROM supplier")
_LCS = "list_last(list_reduce(string_split(a, ''), lambda r, x: list_transform(range(1, len(r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(r[i], CASE WHEN i > 1 AND substr(b, i - 1, 1) = x THEN r[i-1] + 1 ELSE 0 END)))), list_transform(range(length(b) + 1), lambda z: CAST(0 AS BIGINT))))"


@query("j13_fuzzy_match", f"""SELECT supplier_id, match, similarity, matched_by FROM (SELECT *, row_number() OVER (PARTITION BY supplier_id ORDER BY matched_by, round(similarity, 12) DESC, match) AS rn FROM (
  SELECT supplier_id, match, matched_by, 2.0*{_LCS}/(length(a) + length(b)) AS similarity FROM (SELECT supplier_id, a, f AS b, full_name AS match, 'full' AS matched_by FROM sup_left, sup_master UNION ALL SELECT supplier_id, a, s, short_name, 'short' FROM sup_left, sup_master)
  WHERE least(length(a), length(b))*2.0/(length(a) + length(b)) >= 0.85) WHERE similarity >= 0.85 - 1e-12) WHERE rn = 1""", "similarity")
def _j13(w):
    from ..sources.fact import table

    t = table(w.spark, w.folder, "supplier")
    master = t.select(F.concat(F.col("s_name"), F.lit(" trading co")).alias("full_name"), F.concat(F.lit("Co. "), (F.col("s_suppkey") * 7919).cast("string")).alias("short_name"))
    noisy = F.expr(_NOISY)
    name = F.when((F.col("s_suppkey") % 6).isin(3, 4), noisy).otherwise(F.concat(noisy, F.lit(" trading co")))
    return grouping.fuzzy_match(t.select(F.col("s_suppkey").alias("supplier_id"), name.alias("name")), "supplier_id", "name", master, "full_name", "short_name")


# --- sources and sinks: written once to the shared folder and read back -------------------------------------
def _io(w):
    from ..functions.settle import shared_dir
    from ..sources import io

    return io, shared_dir(w.spark)


@query("s01_s02_silver_round_trip", f"SELECT customer_id, month_idx, {d('revenue')} AS revenue FROM cm", "revenue")
def _s02(w):
    import uuid

    io, root = _io(w)
    path = f"{root}/silver-{uuid.uuid4().hex}"
    df = w.customer_month().select("customer_id", "month_idx", dbl("revenue").alias("revenue"))
    io.write_silver(df, path, partition="month_idx")
    return io.read_silver(w.spark, path, df.schema).select("customer_id", "month_idx", "revenue")


@query("s01_newest_silver", f"SELECT customer_id, month_idx, {d('revenue')} AS revenue FROM cm", "revenue")
def _s01(w):
    import uuid

    io, root = _io(w)
    path = f"{root}/silver-{uuid.uuid4().hex}"
    df = w.customer_month().select("customer_id", "month_idx", dbl("revenue").alias("revenue"))
    io.write_silver(df, f"{path}.parquet", csv_path=f"{path}.csv")
    return io.newest_silver(w.spark, f"{path}.csv", df.schema)


query("s03_projected_read", f"SELECT product_id, {d('revenue')} AS revenue FROM fact", "revenue")(lambda w: w.fact("product_id", "revenue").select("product_id", dbl("revenue").alias("revenue")))


@query("s04_gold_writer", "SELECT 'customers' AS table_name, count(*) AS rows FROM cust UNION ALL SELECT 'products', count(*) FROM x_sku")
def _s04(w):
    import uuid

    from ..operators import customer

    io, root = _io(w)
    path = f"{root}/gold-{uuid.uuid4().hex}"
    written = io.write_gold({"customers": w.customers("tier"), "products": customer.sku_lifecycle(w.product_month(), w.latest), "nothing": w.customers("tier").limit(0)}, path)
    frames = [w.spark.read.parquet(p).agg(F.lit(n).alias("table_name"), F.count("*").alias("rows")) for n, p in sorted(written.items())]
    return frames[0].unionByName(frames[1])


@query("s05_customer_master", "SELECT c_custkey AS customer_id, c_mktsegment AS segment, CAST(c_acctbal AS DOUBLE) AS credit, 'unknown' AS owner FROM customer", "credit")
def _s05(w):
    from ..sources.fact import table

    io, _ = _io(w)
    raw = table(w.spark, w.folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("market segment (new)"), F.col("c_acctbal").cast("string").alias("Credit limit"))
    return io.customer_master(raw, {"customer_id": ["custkey"], "segment": ["segment"], "credit": ["credit"], "owner": ["owner"]}, {"owner": "unknown"}, numeric=["credit"])


@query("s09_required_columns_read", f"SELECT customer_id, {d('revenue')} AS amount, CAST(NULL AS VARCHAR) AS agent FROM fact", "amount")
def _s09(w):
    io, _ = _io(w)
    return io.map_fields(w.fact("customer_id", "revenue").withColumn("revenue", dbl("revenue")), {"revenue": "amount"}, critical=["customer_id", "amount"], optional=["agent"])


@query("s06_inventory_load", "SELECT p_brand AS material_id, CAST(sum(p_size) AS DOUBLE) AS under_180d, 0.0 AS d180_to_1y, CAST(sum(p_size) AS DOUBLE) AS over_1y FROM part GROUP BY 1", "under_180d d180_to_1y over_1y")
def _s06(w):
    from ..sources.fact import table

    io, _ = _io(w)
    raw = table(w.spark, w.folder, "part").groupBy(F.concat(F.lit(" "), "p_brand").alias("material_id")).agg(F.sum("p_size").cast("string").alias("0-180"), F.sum("p_size").cast("string").alias(">365"))
    return io.inventory_aging(raw)


@query("s07_bom_load", "SELECT DISTINCT p_brand AS material_id, p_type AS product_id FROM part")
def _s07(w):
    from ..sources.fact import table

    io, _ = _io(w)
    return io.bom(table(w.spark, w.folder, "part").withColumn("p_type", F.concat("p_type", F.lit(" "))), "p_brand", "p_type")
