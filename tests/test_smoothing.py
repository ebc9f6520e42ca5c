"""State-space smoothing against a scalar recursion, exact solutions and other optimisers."""

import itertools
import math
import random

import numpy as np
import pytest

from shipsight.operators import smoothing


def squares(form, y, alpha, beta, gamma, level, trend, seasons):
    """Sum of squares of the search by a plain recursion over one series."""
    s, e, logs = [] if seasons is None else list(seasons), [], 0.0
    for t, x in enumerate(y):
        base = level + trend if form.trend == "add" else level * trend if form.trend == "mul" else level
        season = s[t % form.period] if form.season else None
        mean = base if season is None else base + season if form.season == "add" else base * season
        error = x - mean
        pull = error / season if form.season == "mul" else error
        if form.season:
            s[t % form.period] = season + gamma * (error / base if form.season == "mul" else error)
        if form.trend:
            trend += beta * (pull / level if form.trend == "mul" else pull)
        level = base + alpha * pull
        if form.error == "mul":
            if mean <= 0:
                return math.inf
            e.append(error / mean)
            logs += math.log(mean)
        else:
            e.append(error)
    unit = math.exp(logs / len(y)) if form.error == "mul" else 1.0
    return sum((x * unit) ** 2 for x in e)


def series(seed, n, level=10.0, trend=0.1, season=0.0, noise=0.5, period=12):
    rng = random.Random(seed)
    return np.array([max(level + trend * t + season * math.sin(2 * math.pi * t / period) + rng.gauss(0, noise), 0.1) for t in range(n)])


ALL = [f for f in smoothing.forms(4)]


@pytest.mark.parametrize("form", ALL, ids=lambda f: f.name)
def test_recursion_and_optimum(form):
    y = series(3, 40, season=2.0, period=4) / 10
    fit = smoothing.Fit(form, y[None, :], np.array([0]))
    theta, cost = fit.search()
    alpha, beta, gamma, level, trend, seasons = fit.split(theta)
    # the alignment at the end: with 40 points and four seasons, the first season comes first
    plain = lambda a, b, g, lv, tr, ss: squares(form, y, a, b, g, lv, tr, ss)
    best = plain(alpha[0], beta[0], gamma[0], level[0], trend[0], None if seasons is None else seasons[0])
    assert math.isclose(best, cost[0], rel_tol=1e-9)
    rng = random.Random(1)
    least, at = math.inf, None
    for _ in range(4000):  # a random search that ends in small steps finds nothing clearly better
        if at is None or rng.random() < 0.2:
            th = fit.start((rng.uniform(0.02, 0.98), rng.uniform(0.02, 0.98), rng.uniform(0.02, 0.98)))[0] + np.array([rng.gauss(0, 0.1) for _ in range(theta.shape[1])])
        else:
            th = at + np.array([rng.gauss(0, 0.05) for _ in range(theta.shape[1])])
        a, b, g, lv, tr, ss = fit.split(th[None, :])
        c = plain(a[0], b[0], g[0], lv[0], tr[0], None if ss is None else ss[0])
        if c < least:
            least, at = c, th
    assert cost[0] <= least * 1.001


def test_level_model_equals_the_exact_solution():
    """With additive error and no trend, residuals are linear in the first level: solve for it on a fine grid of weights."""
    y = series(9, 30, trend=0.0)
    best = math.inf
    for alpha in np.linspace(0, 1, 2001):
        unit, base = np.zeros(30), np.zeros(30)  # residual = base - level * unit
        l0, l1 = 0.0, 1.0
        for t, x in enumerate(y):
            base[t], unit[t] = x - l0, l1
            l0, l1 = l0 + alpha * (x - l0), l1 * (1 - alpha)
        level = (base @ unit) / (unit @ unit)
        best = min(best, float(((base - level * unit) ** 2).sum()))
    form = smoothing.Form("add", None)
    _, cost = smoothing.Fit(form, y[None, :], np.array([0])).search()
    assert math.isclose(cost[0], best, rel_tol=1e-4)
    aic = 30 * (math.log(2 * math.pi * best / 30) + 1) + 2 * 3
    assert math.isclose(smoothing.likelihood(cost, np.array([30]), np.array([1.0]))[0] + 2 * form.free, aic, rel_tol=1e-4)


def test_forms_by_length_and_sign():
    named = lambda n, positive=True, period=0: [f.name for f in smoothing.forms(period) if f.fits(np.array([n]), np.array([positive]))[0]]
    assert named(3) == []
    assert named(4) == ["ETS(add,add,N)", "ETS(add,N,N)"]
    assert named(12) == ["ETS(add,add,N)", "ETS(add,N,N)", "ETS(mul,add,N)"]
    assert len(named(18)) == 6 and len(named(23, period=12)) == 6 and len(named(24, period=12)) == 14
    assert named(40, positive=False, period=12) == ["ETS(add,add,add)", "ETS(add,N,add)", "ETS(add,add,N)", "ETS(add,N,N)"]


def test_a_series_is_fitted_alike_in_any_company():
    many = [series(i, n, season=i % 3) for i, n in enumerate([4, 5, 12, 17, 18, 30, 47])] + [np.zeros(6), np.array([100.0, 200, 150, 300])]
    together = smoothing.fitted(many, 3, 12)
    for i, one in enumerate(many):
        alone = smoothing.fitted([one], 3, 12)
        assert together["model"][i] == alone["model"][0]
        assert np.allclose(together["forecast"][i], alone["forecast"][0], rtol=1e-3, atol=1e-6)
    assert together["forecast"][7].tolist() == [0, 0, 0] and together["direction"][7] == "flat"


def test_a_season_is_found_and_continued():
    y = 100 + 30 * np.sin(2 * np.pi * np.arange(48) / 12) + np.random.default_rng(2).normal(0, 1, 48)
    out = smoothing.fitted([y], 12, 12)
    assert out["model"][0].endswith("add)") or out["model"][0].endswith("mul)")
    assert np.abs(out["forecast"][0] - (100 + 30 * np.sin(2 * np.pi * np.arange(48, 60) / 12))).max() < 5
    assert 0 < out["spread"][0].min() and out["spread"][0].max() < 3


def test_every_series_has_its_rows(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, None), (3, []), (4, [5.0, None, -3.0, 8.0, 9.0]), (5, [float(x) for x in range(1, 31)]), (5, [float(x) for x in range(1, 31)])]
    got = smoothing.ets(spark.createDataFrame(rows, "k int, v array<double>").repartition(3), ["k"], h=2).collect()
    assert sorted((r.k, r.step) for r in got) == sorted(itertools.product([1, 2, 3, 4, 5, 5], [1, 2]))
    by = {(r.k, r.step): r for r in got}
    assert all(by[k, 1].model is None and by[k, 1].forecast is None and by[k, 1].low_80 is None and by[k, 1].direction == "short" for k in (1, 2, 3))
    assert by[4, 1].model.startswith("ETS(add") and by[4, 1].forecast is not None
    assert abs(by[5, 1].forecast - 31) < 0.5 and by[5, 2].direction == "up" and by[5, 2].low_95 <= by[5, 2].low_80 <= by[5, 2].forecast <= by[5, 2].high_80
    assert smoothing.ets(spark.createDataFrame([], "k int, v array<double>"), ["k"]).count() == 0
