"""Literal frames: nulls, zero denominators, ties and one row per branch."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from shipsight.operators import (
    actions, address, anomaly, behaviour, bridge, cleaning, customer, datasets, evaluate, forecast, grouping, insights, pricing, product, quality, risk, scoring, smoothing, trend,
)
from shipsight.sources import io


def rows(df, key=None):
    r = [x.asDict() for x in df.collect()]
    return {x[key]: x for x in r} if key else r


def months(data):
    """(customer, month_idx, revenue[, profit, qty, orders]) -> rows with a first-of-month date."""
    out = []
    for c, m, r, *rest in data:
        p, q, o = (list(rest) + [0.0, 1.0, 1])[:3] if rest else (0.0, 1.0, 1)
        out.append((c, date((m - 1) // 12, (m - 1) % 12 + 1, 1), m, float(q), float(r), float(r) - p, float(p), int(o)))
    return out


CM = "customer_id string, month date, month_idx int, qty double, revenue double, cost double, profit double, orders bigint"
L = 2001 * 12 + 6


def test_declining_share_and_pivot(spark):
    cpm = spark.createDataFrame([("c1", "p1", 100.0), ("c1", "p2", 300.0), ("c2", "p9", 50.0)], "customer_id string, product_id string, revenue double")
    pp = spark.createDataFrame([("p1", "growth", "low", "key", "invest", 0.1, 0.2), ("p2", "decline", "high", "key", "exit", -0.5, 0.1)], "product_id string, portrait string, risk_level string, pareto string, zone string, growth double, margin double")
    b = bridge.customer_product_bridge(cpm, pp)
    assert b.count() == 3
    h = rows(bridge.portfolio_health(b), "customer_id")
    assert h["c1"]["declining_share"] == 0.75 and h["c2"]["declining_share"] == 0.0
    assert rows(bridge.portfolio_pivot(b), "customer_id")["c1"]["risk_share"] == 0.75


def test_purchase_interval_and_churn(spark):
    cm = spark.createDataFrame(months([("a", L - 20, 1), ("a", L - 12, 1), ("a", L - 10, 1), ("a", L - 8, 1), ("b", L, 5)]), CM)
    i = customer.purchase_interval(cm)
    r = rows(customer.churn_warning(cm, i, L), "customer_id")
    assert 59 <= r["a"]["interval_days"] <= 62 and r["a"]["interrupted"]
    assert r["b"]["interval_days"] is None and not r["b"]["interrupted"]


def test_customer_lifecycle_branches(spark):
    long = [(L - k, 100) for k in range(30, 12, -1)]
    data = [("lost", L - 20, 1), ("sleep", L - 8, 1), ("intro", L - 2, 1)]
    data += [("mature", m, r) for m, r in long] + [("mature", L - k, 100) for k in range(12, -1, -1)]
    data += [("decline", m, r) for m, r in long] + [("decline", L - k, 100) for k in range(11, 2, -1)] + [("decline", L - k, 10) for k in (2, 1, 0)]
    data += [("ramp", m, r) for m, r in long] + [("ramp", L - k, 100) for k in (5, 4, 3)] + [("ramp", L - k, 150) for k in (2, 1, 0)]
    r = rows(customer.customer_lifecycle(spark.createDataFrame(months(data), CM), L), "customer_id")
    assert {k: v["lifecycle"] for k, v in r.items()} == {k: k for k in ("lost", "sleep", "intro", "mature", "decline", "ramp")}
    assert r["lost"]["lifecycle_confidence"] == "low" and r["mature"]["lifecycle_confidence"] == "high"


def test_journey_branches(spark):
    data = [("onboarding", L - 1, 10), ("lost", L - 20, 10), ("lost", L - 19, 10)]
    data += [("reactivated", L - 20, 10), ("reactivated", L, 10)]
    data += [("decline", L - k, 100) for k in range(11, 5, -1)] + [("decline", L - 5 + i, v) for i, v in enumerate((60, 50, 40, 30, 20, 10))]
    data += [("growth", L - k, 100) for k in range(11, 5, -1)] + [("growth", L - k, 200) for k in range(5, -1, -1)]
    data += [("mature", L - k, 1000) for k in range(13, -1, -1)]
    r = rows(behaviour.journey(spark.createDataFrame(months(data), CM), L), "customer_id")
    assert {k: v["journey"] for k, v in r.items()} == {k: k for k in ("onboarding", "lost", "reactivated", "decline", "growth", "mature")}


def test_volatility_equals_dense_series(spark):
    rng = np.random.default_rng(3)
    data, dense = [], {}
    for c in "abc":
        v = np.where(rng.random(24) < 0.5, 0, rng.integers(1, 100, 24)).astype(float)
        dense[c] = v
        data += [(c, L - 23 + i, x) for i, x in enumerate(v) if x]
    data += [("full", L - 23 + i, 7.0) for i in range(24)]
    r = rows(behaviour.volatility(spark.createDataFrame(months(data), CM)), "customer_id")
    for c, v in dense.items():
        d = np.diff(v)
        drop = max([abs(x) / max(p, 1) for x, p in zip(d, v[:-1]) if x < 0], default=0)
        assert r[c]["revenue_cv"] == pytest.approx(v.std(ddof=1) / v.mean())
        assert r[c]["max_drop"] == pytest.approx(drop) and r[c]["zero_share"] == pytest.approx((v == 0).mean())
        assert r[c]["trend_r2"] == pytest.approx(np.corrcoef(np.arange(24), v)[0, 1] ** 2)
    assert r["full"]["revenue_cv"] == 0 and r["full"]["trend_r2"] == 0


def test_pareto_crossing_customer_falls_below(spark):
    df = spark.createDataFrame([("a", 60.0, 1.0), ("b", 20.0, 1.0), ("c", 15.0, 1.0), ("d", 5.0, 1.0), ("x", 9.0, 0.0)], "customer_id string, profit_12m double, revenue_12m double")
    r = rows(scoring.pareto_tiers(df), "customer_id")
    assert [r[k]["pareto"] for k in "abcdx"] == ["A", "B", "C", "D", "D"]


def test_true_profit_levels(spark):
    df = spark.createDataFrame([("a", 5000.0, 10000.0, 10), ("b", 100.0, 10000.0, 1), ("c", 10.0, 10000.0, 5), ("d", 0.0, 0.0, 0)], "customer_id string, profit_12m double, revenue_12m double, orders_12m bigint")
    r = rows(scoring.true_profit(df), "customer_id")
    assert r["a"]["true_profit"] == 4500 and r["a"]["profit_level"] == "high"
    assert r["b"]["profit_level"] == "thin" and r["c"]["profit_level"] == "loss" and r["d"]["order_cost"] == 0


def test_half_windows_for_each_month():
    for m in range(1, 13):
        p = datasets.Periods(2001 * 12 + m)
        assert p.half_start == 2001 * 12 + (1 if m <= 7 else 7)
        assert (p.year, p.month) == (2001, m)


def test_window_anchor_empty_and_first_month(spark):
    f = spark.createDataFrame([(2001 * 12 + 1,)], "month_idx int")
    assert rows(datasets.window_anchor(f, datasets.Periods(2001 * 12 + 3)))[0] == {"anchor": 2001 * 12 + 1, "anchor_prev": None}
    assert rows(datasets.window_anchor(f, datasets.Periods(2001 * 12 + 9)))[0] == {"anchor": None, "anchor_prev": None}


def test_null_dates_and_returns(spark):
    df = spark.createDataFrame([("2001-02-03", 1.0), (None, 2.0), ("nonsense", 3.0)], "ship_date string, qty double")
    assert [r["qty"] for r in cleaning.coerce_date(df, "ship_date").collect()] == [1.0]
    assert cleaning.handle_returns(spark.createDataFrame([(-1.0,), (2.0,)], "qty double"), strict=True).count() == 1


def test_key_fallback_and_backfill(spark):
    df = spark.createDataFrame([(" ", "agent1", "x"), ("end", None, "x"), (None, None, None)], "end_customer string, agent string, actual string")
    assert [(r["customer_id"], r["customer_id_source"]) for r in cleaning.key_fallback(df, ["end_customer", "agent", "actual"]).collect()] == [("agent1", "agent"), ("end", "end_customer"), ("unknown", "default")]
    lines = spark.createDataFrame([("p", "A"), ("p", "A"), ("p", "B"), ("p", None), ("q", None)], "product_id string, product_line string")
    got = sorted((r["product_id"], r["product_line"], r["line_source"]) for r in cleaning.backfill_line(lines).collect())
    assert got.count(("p", "A", "same_product")) == 1 and ("q", "unclassified", "default") in got and len(got) == 5


def test_price_bands_and_zero_quantity(spark):
    data = [("c1", "p", 10.0, 1.0, 10.0), ("c2", "p", 20.0, 1.0, 20.0), ("c3", "p", 30.0, 1.0, 30.0), ("c4", "p", 5.0, 0.0, None)]
    r = rows(pricing.price_bands(spark.createDataFrame(data, "customer_id string, product_id string, revenue double, qty double, price double")), "customer_id")
    assert r["c1"]["low_share"] == 1.0 and r["c2"]["mid_share"] == 1.0 and r["c3"]["high_share"] == 1.0


def test_elasticity_and_trend(spark):
    pm = spark.createDataFrame([("p", i, 10.0 * 0.9**i, 100.0 * 1.2**i) for i in range(6)] + [("q", 0, 5.0, 1.0)], "product_id string, month_idx int, avg_price double, qty double")
    r = rows(pricing.price_elasticity(pm), "product_id")
    assert r["p"]["elasticity"] == pytest.approx(-2.0) and r["p"]["sensitivity"] == "high" and "q" not in r
    t = rows(pricing.asp_trend(pm), "product_id")
    y = 10.0 * 0.9 ** np.arange(6)
    assert t["p"]["asp_trend"] == pytest.approx(np.polyfit(range(6), y, 1)[0] / y.mean()) and t["q"]["asp_trend"] == 0


def test_nine_grid_covers_all_cells(spark):
    df = spark.createDataFrame([(m, h) for m, h, _, _ in product.GRID], "m string, h string")
    p, z = product.nine_grid(F.col("m"), F.col("h"))
    got = [(r["p"], r["z"]) for r in df.select(p.alias("p"), z.alias("z")).collect()]
    assert got == [(x[2], x[3]) for x in product.GRID]


@pytest.mark.parametrize("decay,yoy,falls,expect", [(5.0, 0.6, 0, 20), (-20.0, -0.5, 0, 70), (1.0, -0.5, 9, 100), (0.0, -0.05, 2, 70), (None, 0.1, 3, 20), (-5.0, None, 0, 50)])
def test_decay_score(spark, decay, yoy, falls, expect):
    df = spark.createDataFrame([(decay, yoy, falls)], "d double, y double, f int")
    assert df.select(product.score_decay(F.col("d"), F.col("y"), F.col("f")).alias("s")).first()["s"] == expect


def test_composite_renormalises(spark):
    df = spark.createDataFrame([(10, 80, 40, True), (10, 80, 40, False)], "a int, b int, c int, ok boolean")
    s = product.composite([F.col("a"), F.col("b"), F.col("c")], (0.1, 0.6, 0.2), (F.col("ok"), F.lit(True), F.lit(True)))
    assert [r["s"] for r in df.select(s.alias("s")).collect()] == pytest.approx([(1 + 48 + 8) / 0.9, (48 + 8) / 0.8])


def test_bom_split_by_sales_and_equal(spark):
    inv = spark.createDataFrame([("m1", 100.0, 0.0, 100.0), ("m2", 10.0, 0.0, 0.0)], "material_id string, under_180d double, d180_to_1y double, over_1y double")
    bom = spark.createDataFrame([("m1", "p1"), ("m1", "p2"), ("m1", "p2"), ("m2", "p3"), ("m2", "p4")], "material_id string, product_id string")
    pm = spark.createDataFrame([("p1", L, 30.0), ("p2", L, 10.0)], "product_id string, month_idx int, qty double")
    r = rows(insights.explode_to_finished(inv, bom, pm, L), "product_id")
    assert r["p1"]["stock"] == 150 and r["p2"]["stock"] == 50 and r["p3"]["stock"] == r["p4"]["stock"] == 5
    assert r["p1"]["over_1y_share"] == 0.5
    raw = spark.createDataFrame([(" m1 ", "5", "x")], "material_id string, `0-180` string, `>365` string")
    assert rows(io.inventory_aging(raw))[0] == {"material_id": "m1", "under_180d": 5.0, "d180_to_1y": 0.0, "over_1y": 0.0}


def test_association_support_uses_baskets_of_two(spark):
    data = [(b, i) for b in range(8) for i in ("a", "b")] + [(9, "a"), (10, "a"), (10, "c"), (11, "b"), (11, "c")]
    r = {(x["item"], x["with_item"]): x for x in rows(insights.association_rules(spark.createDataFrame(data, "b int, i string"), ["b"], "i"))}
    assert r["a", "b"]["support"] == pytest.approx(0.8) and r["a", "b"]["confidence"] == pytest.approx(8 / 9) and r["a", "b"]["baskets"] == 8
    assert r["c", "a"]["confidence"] == pytest.approx(0.5)


def test_pair_counts_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    data = [(int(b), m, int(i)) for b in range(60) for m in range(2) for i in rng.choice(30, rng.integers(0, 12))] + [(99, 0, i) for i in range(30)] + [(None, 1, 1), (5, None, 2), (5, 1, None)]
    got = {(x["item"], x["with_item"]): x["baskets"] for x in rows(insights.association_rules(spark.createDataFrame(data, "c int, m int, i int"), ["c", "m"], "i", min_support=0.03, min_confidence=0.0))}
    baskets = {}
    for c, m, i in data:
        if None not in (c, m, i):
            baskets.setdefault((c, m), set()).add(i)
    baskets = [b for b in baskets.values() if len(b) >= 2]
    want = {}
    for b in baskets:
        for x in b:
            for y in b - {x}:
                want[x, y] = want.get((x, y), 0) + 1
    assert got == {k: n for k, n in want.items() if n >= 0.03 * len(baskets)}
    gated = lambda n: insights.gated_association(spark.createDataFrame(data, "c int, m int, i int"), ["c", "m"], "i", min_rows=n, min_support=0.03).count()
    assert gated(len(data)) > 0 and gated(len(data) + 1) == 0


def test_cross_sell_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    prods = [(f"p{i:02d}", f"g{i % 4}", float(rng.integers(0, 8)), bool(rng.random() < 0.15)) for i in range(40)]
    bought = {(f"c{c}", prods[i][0]) for c in range(12) for i in rng.choice(40, rng.integers(1, 38), replace=False)}
    bought |= {("c0", p[0]) for p in prods[:39]}
    grp = {p[0]: p[1] for p in prods}
    cpm = spark.createDataFrame([(c, p, grp[p]) for c, p in sorted(bought)], "customer_id string, product_id string, product_line string")
    scores = spark.createDataFrame([(p, s, d, None) for p, _, s, d in prods if any(b[1] == p for b in bought)], "product_id string, score double, dead_stock boolean, portrait string")
    rules = spark.createDataFrame([(prods[i][0], prods[j][0], 0.4) for i, j in rng.integers(0, 40, (30, 2)) if i != j], "item string, with_item string, confidence double").dropDuplicates(["item", "with_item"])
    rl = {(r["item"], r["with_item"]): r["confidence"] * 5 for r in rules.collect()}
    got = {}
    for r in insights.cross_sell(cpm, scores, rules).orderBy("customer_id", "rank").collect():
        got.setdefault(r["customer_id"], []).append(r["product_id"])
    sold = {b[1] for b in bought}
    for c in {b[0] for b in bought}:
        mine = {p for cc, p in bought if cc == c}
        cand = [(-int(d), -(s + (3 if grp[p] in {grp[m] for m in mine} else 0) + sum(rl.get((m, p), 0) for m in mine)), p) for p, _, s, d in prods if p in sold and p not in mine]
        assert got.get(c, []) == [x[2] for x in sorted(cand)[:5]], c


def test_bridge_effects_add_up(spark):
    data = [("p1", L, 10.0, 100.0, 60.0), ("p1", L - 12, 8.0, 90.0, 50.0), ("p2", L, 5.0, 20.0, 15.0), ("p3", L - 12, 4.0, 40.0, 30.0)]
    df = spark.createDataFrame(data, "product_id string, month_idx int, qty double, revenue double, cost double").withColumn("profit", F.col("revenue") - F.col("cost"))
    r = rows(insights.profit_bridge(df, L))[0]
    parts = sum(r[f"{x}_effect"] for x in ("volume", "price", "cost", "mix")) + r["other_products"]
    assert parts == pytest.approx(r["profit_now"] - r["profit_before"]) and r["comparable_products"] == 1


def test_risk_merge_and_month_over_month(spark):
    s = spark.createDataFrame([("e1", "a", "medium", 5.0, "x"), ("e1", "b", "high", 20000.0, "y"), ("e1", "b", "low", 1.0, "y"), ("e2", "a", "low", 0.0, "x")], "entity string, kind string, level string, loss double, channel string")
    m = risk.merge_signals(s)
    r = rows(m, "entity")
    assert r["e1"]["level"] == "high" and r["e1"]["loss"] == 20000 and r["e1"]["kinds"] == ["b", "a"] and r["e1"]["signals"] == 3
    prev = spark.createDataFrame([("e1", "high", 40000.0, ["b"], 2), ("e2", "high", 0.0, ["z"], 1), ("e3", "low", 1.0, ["a"], 4)], "entity string, level string, loss double, kinds array<string>, months int")
    o = {(x["entity"], x["state"]): x for x in rows(risk.month_over_month(m, prev))}
    assert o["e1", "continuing"]["months"] == 3 and o["e1", "continuing"]["change"] == "better"
    assert o["e2", "new"]["months"] == 0 and ("e2", "released") in o and o["e3", "released"]["months"] == 4 and len(o) == 4


def test_revenue_shock_channel_skips_null_change(spark):
    t = spark.createDataFrame([("a", L, 200000.0, -60.0), ("b", L, 200000.0, None), ("c", L, 150000.0, 80.0), ("d", L, 10.0, -90.0)], "customer_id string, month_idx int, revenue double, mom double")
    r = rows(risk.channel_revenue_shock(t, L), "entity")
    assert set(r) == {"a", "c"} and r["a"]["loss"] == pytest.approx(300000) and r["c"]["kind"] == "new_import"


@pytest.mark.parametrize("text,region,abroad", [
    ("广东省深圳市南山区科技园", "广东", False), ("深圳市宝安区", "广东", False), ("收货地址：江苏省苏州市", "江苏", False), ("FOB HONG KONG", "香港", True), ("香港九龙", "香港", True),
    ("SEOUL KOREA", "韩国", True), ("Unit 5 Some Road", "overseas", True), ("123", "unknown", False), (None, "unknown", False), ("台湾新竹", "台湾", True),
])
def test_address_rules(spark, text, region, abroad):
    places = [("province", 1, "广东", "广东", "", False), ("province", 2, "江苏", "江苏", "", False), ("city", 1, "深圳", "广东", "深圳市", False), ("place", 1, "新竹", "台湾", "新竹市", True), ("place", 2, "九龙", "香港", "九龙", True), ("place", 3, "SEOUL", "韩国", "首尔", True)]
    r = rows(address.resolve(spark.createDataFrame([(text,)], "address string"), spark.createDataFrame(places, address.PLACES), patterns=[(2, r"HONG\s?KONG", "香港", "", True)], prefixes=["收货地址："]))[0]
    assert (r["region"], r["abroad"]) == (region, abroad)


def test_groups_and_matching(spark):
    df = spark.createDataFrame([(1, "Acme one"), (2, "xyz ACME"), (3, "宏图电子一"), (4, "宏图电子二"), (5, "宏图电子三"), (6, "单独公司")], "customer_id int, name string")
    r = {x["customer_id"]: x["group_name"] for x in rows(grouping.identify_groups(df, {"ACME": ["acme"]}))}
    assert r[1] == r[2] == "ACME" and r[3] == r[4] == r[5] == "宏图电" and r[6] == ""


def test_fuzzy_match_is_exhaustive(spark):
    import random

    rnd = random.Random(1)
    full = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(6, 24))).strip() or "zz" for _ in range(40)]
    def damage(s):
        s = list(s)
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randrange(len(s))
            rnd.choice([lambda: s.__setitem__(i, "x"), lambda: s.insert(i, "y"), lambda: len(s) > 3 and s.pop(i)])()
        return "".join(s)
    left = [(i, damage(rnd.choice(full))) for i in range(60)]
    left += [(100, None), (101, "  "), (102, "a"), (103, "ab"), (104, "😀😀x")]
    full += ["a", "abc", "😀😀xy", "😀😀x "]
    got = {r["i"]: (r["similarity"], r["match"]) for r in grouping.fuzzy_match(spark.createDataFrame(left, "i int, n string"), "i", "n", spark.createDataFrame([(f,) for f in full], "f string"), "f").collect()}

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for ratio in (0.85, 0.6):
        got = {r["i"]: (r["similarity"], r["match"]) for r in grouping.fuzzy_match(spark.createDataFrame(left, "i int, n string"), "i", "n", spark.createDataFrame([(f,) for f in full], "f string"), "f", ratio=ratio).collect()}
        for i, n in left:
            n = (n or "").strip().lower()
            scored = sorted((-2 * common(n, f.strip()) / (len(n) + len(f.strip())), f) for f in full) if n else [(0, "")]
            assert got.get(i) == ((pytest.approx(-scored[0][0]), scored[0][1]) if -scored[0][0] >= ratio else None)


def test_names_with_a_common_suffix_make_few_candidates(spark):
    import random

    rnd = random.Random(3)
    names = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) + " co ltd" for _ in range(600)]
    frame = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    known = grouping._letter_pairs(frame(names))
    pairs = grouping._signatures(known, 0.85, True).withColumnRenamed("name", "a").join(grouping._signatures(known, 0.85, False).withColumnRenamed("name", "b"), ["la", "lb", "sign"]).select("a", "b").distinct().filter("a <> b").count()
    assert pairs < 0.05 * len(names) ** 2  # the suffix alone would pair all
    off = [n[:5] + n[6:] for n in names]
    got = {(r.a, r.b) for r in grouping.similar_names(frame(off), frame(names)).collect()}
    assert set(zip(off, names)) <= got


def test_forecast_methods_match_numpy(spark):
    v = [5.0, 7.0, 6.0, 9.0, 12.0, 10.0, 11.0, 15.0, 14.0, 13.0, 17.0, 18.0]
    s = spark.createDataFrame([("s", v)], "k string, v array<double>")
    r = {x["method"]: x["prediction"] for x in rows(forecast.all_methods(s))}
    y = np.array(v)
    w = np.arange(1, 5)
    assert r["last"] == 18 and r["mean_4"] == pytest.approx(y[-4:].mean()) and r["median_3"] == 17
    assert r["linear_weighted_4"] == pytest.approx(y[-4:] @ w / w.sum())
    e = 0.5 ** np.arange(3, -1, -1)
    assert r["ewma_4_5"] == pytest.approx(y[-4:] @ e / e.sum())
    b, a = np.polyfit(range(6), y[-6:], 1)
    assert r["trend_6"] == pytest.approx(a + b * 6)
    b, a = np.polyfit(range(4), np.log1p(y[-4:]), 1)
    assert r["log_trend_4"] == pytest.approx(np.expm1(a + b * 4))
    assert r["drift_3"] == pytest.approx(18 + (18 - 13) / 2)
    assert r["seasonal_4"] == pytest.approx(14 * y[-4:].sum() / y[-8:-4].sum())
    assert r["growth_3"] == pytest.approx(y[-4:].mean() * 1.03)


def test_croston_family(spark):
    s = spark.createDataFrame([("a", [0.0, 4.0, 0.0, 0.0, 6.0, 0.0]), ("z", [0.0] * 6)], "k string, v array<double>")
    r = {x["k"]: x for x in rows(s.select("k", forecast.croston(F.col("v"), 0.2).alias("c"), forecast.tsb(F.col("v"), 0.2, 0.1).alias("t"), forecast.adida(F.col("v"), 3).alias("ad")))}
    assert r["a"]["c"] == pytest.approx((0.2 * 6 + 0.8 * 4) / (0.2 * 3 + 0.8 * 1)) and r["z"]["c"] == 0 and r["z"]["t"] == 0
    assert r["a"]["ad"] == pytest.approx((0.3 * 6 + 0.7 * 4) / 3)


def test_ets_follows_a_line(spark):
    s = spark.createDataFrame([("t", [float(10 + 2 * i) for i in range(24)]), ("flat", [5.0] * 24)], "k string, v array<double>")
    r = rows(smoothing.ets(s, ["k"], h=2))
    t = [x for x in r if x["k"] == "t" and x["step"] == 2][0]
    assert t["forecast"] == pytest.approx(10 + 2 * 25, rel=0.05) and t["direction"] == "up"
    assert [x["direction"] for x in r if x["k"] == "flat"] == ["flat", "flat"]


def test_reconciled_detail_sums_to_anchor(spark):
    d = spark.createDataFrame([("a", 1, 10.0), ("b", 1, 30.0)], "k string, step int, forecast double")
    a = spark.createDataFrame([(1, 80.0)], "step int, anchor double")
    assert sorted(r["reconciled"] for r in forecast.reconcile_to_total(d, a).collect()) == [20.0, 60.0]


def test_auc_and_confusion(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    pos, neg = s[y == 1], s[y == 0]
    exp = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    r = rows(evaluate.classification_metrics(df, "score", 0.5))[0]
    assert r["auc"] == pytest.approx(exp) and r["tp"] == int(((s > 0.5) & (y == 1)).sum())
    assert len(evaluate.weight_grid(3, 10)) == 66


def test_pareto_frontier(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 4.0), (3, 1.0, 4.0), (4, 2.0, 4.0)], "id int, a double, b double")
    assert sorted(r["id"] for r in evaluate.pareto_frontier(df, ["a", "b"], ["id"]).collect()) == [1, 2, 4]


def test_isolation_forest_flags_the_outlier(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (400, 3))
    x[0] = (40.0, -40.0, 40.0)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "customer_id int, a double, b double, c double")
    r = rows(anomaly.isolation_forest(df, ["a", "b", "c"], trees=50, contamination=0.02), "customer_id")
    assert 0 in r and len(r) <= 8
    again = rows(anomaly.isolation_forest(df.repartition(9), ["a", "b", "c"], trees=50, contamination=0.02), "customer_id")
    assert {k: x["score"] for k, x in again.items()} == {k: x["score"] for k, x in r.items()}


def test_least_hashes_per_tree_are_those_of_all_rows():
    import pandas as pd

    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"_h": rng.integers(-(2**62), 2**62, 500), "x": list(rng.normal(size=(500, 2)))})
    whole = pd.concat(anomaly._least([frame], 6, 40, 42))
    parts = pd.concat([p for part in range(3) for p in anomaly._least([frame.iloc[part * 170 : part * 170 + 90], frame.iloc[part * 170 + 90 : part * 170 + 170]], 6, 40, 42)])
    key = lambda h: np.asarray(h, np.int64).view(np.uint64)
    for t in range(6):
        best = sorted(key(parts[parts.tree == t]["_h"]))[:40]
        assert best == sorted(key(whole[whole.tree == t]["_h"]))
    assert len({tuple(x) for t in range(6) for x in whole[whole.tree == t]["x"]}) > 150  # trees differ


def test_profile_drift_and_validation(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "k int, v double")
    same = quality.profile_drift(quality.table_profile(a, "t"), quality.table_profile(a, "t"))
    assert same.count() == 0
    d = rows(quality.profile_drift(quality.table_profile(a, "t"), quality.table_profile(a.limit(1), "t")))
    assert {x["measure"] for x in d} >= {"rows"}
    v = rows(quality.staged_validation(a, "raw", ["k", "zz"], {"v": 0.1}, {"k": (2, None)}))
    assert {(x["check"], x["passed"]) for x in v} == {("null", False), ("range", False), ("not_empty", True), ("required", False)}


def test_io_field_map_fails_on_missing(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        io.map_fields(df, {"a": "b"}, critical=["c"])
    assert io.map_fields(df, {"a": "b"}, critical=["b"], optional=["x"]).columns == ["b", "x"]


def test_simple_actions_empty(spark):
    p = spark.createDataFrame([("a", 0.1, 5, False, False, "mature", 0.0, 0.0, "mature")], "customer_id string, new_share double, products int, interrupted boolean, dependent boolean, lifecycle string, lost_share double, low_share double, main_sku_stage string")
    assert rows(actions.simple_actions(p))[0] == {"customer_id": "a", "actions": "no action", "action_count": 0}


def test_trend_needs_previous_above_one(spark):
    cm = spark.createDataFrame(months([("a", L - 2, 0.5), ("a", L - 1, 10), ("a", L, 15)]), CM)
    r = rows(trend.revenue_trend(cm), "month_idx")
    assert r[L - 1]["mom"] is None and r[L]["mom"] == pytest.approx(50) and r[L]["slope"] == pytest.approx(7.25)
