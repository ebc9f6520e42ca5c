"""Exponential smoothing as state-space models: error, trend and season additive or multiplicative, by maximum likelihood.

A series is one array, bounded by the calendar. Series of an Arrow batch are fitted together, whatever their lengths: they
are aligned at their ends, and states rest until a series begins. The likelihood of all forms, with the variance concentrated
out, is a sum of squares: for a multiplicative error the relative residuals times the geometric mean of the fitted values.
So one batched Levenberg-Marquardt search over smoothing weights and starting states serves every form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LEAST = 4  # points
ROUNDS, STEP, TINY = 60, 1e-6, 1e-10
#: Smoothing weights (level, trend as a share of it, season as a share of the rest) from which each search starts.
STARTS = ((0.1, 0.1, 0.05), (0.5, 0.1, 0.1), (0.9, 0.1, 0.5))
#: Normal quantiles of the two-sided bands.
BANDS = {"80": 1.2815515655446004, "95": 1.959963984540054}
FAR = 0.05  # of the mean: a last forecast further from the last value is a direction


@dataclass(frozen=True)
class Form:
    """A form of the model; None stands for no trend or season."""

    error: str
    trend: str | None
    season: str | None = None
    period: int = 0

    @property
    def name(self) -> str:
        return f"ETS({self.error},{self.trend or 'N'},{self.season or 'N'})"

    @property
    def weights(self) -> int:
        return 1 + (self.trend is not None) + (self.season is not None)

    @property
    def free(self) -> int:
        """Weights, starting states and the variance."""
        return self.weights + 1 + (self.trend is not None) + (self.period if self.season else 0) + 1

    def fits(self, n: np.ndarray, positive: np.ndarray) -> np.ndarray:
        """For which series, by length and by whether all values are above 0, the form is tried."""
        if self.season:
            long_enough = n >= max(24, 2 * self.period)
        else:
            long_enough = {("add", "add"): n >= LEAST, ("add", None): n >= LEAST, ("mul", "add"): n >= 12}.get((self.error, self.trend), n >= 18)
        return long_enough & (positive | ("mul" not in (self.error, self.trend, self.season)))


def forms(period: int = 0) -> list[Form]:
    """The forms in the order in which equal criteria are decided: seasonal ones first."""
    out = [Form(e, t, s, period) for e in ("add", "mul") for t in ("add", None) for s in ("add", "mul")] if period >= 2 else []
    return out + [Form(e, t) for e in ("add", "mul") for t in ("add", "mul", None)]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


class Fit:
    """One form over many series: values (series x time, aligned at the end), and where each begins."""

    def __init__(self, form: Form, y: np.ndarray, begin: np.ndarray):
        self.form, self.y, self.begin = form, y, begin
        self.active = np.arange(y.shape[1]) >= begin[:, None]
        self.n = self.active.sum(1)

    def split(self, theta: np.ndarray) -> tuple:
        """Weights and starting states of a parameter array (series x parameters)."""
        f, k = self.form, self.form.weights
        alpha = logistic(theta[:, 0])
        beta = alpha * logistic(theta[:, 1]) if f.trend else np.zeros(len(theta))
        gamma = (1 - alpha) * logistic(theta[:, k - 1]) if f.season else np.zeros(len(theta))
        level = theta[:, k]
        trend = theta[:, k + 1] if f.trend == "add" else np.exp(np.clip(theta[:, k + 1], -3, 3)) if f.trend == "mul" else np.zeros(len(theta))
        seasons = None
        if f.season:
            seasons = theta[:, -f.period :]
            seasons = seasons - seasons.mean(1, keepdims=True) if f.season == "add" else np.exp(np.clip(seasons - seasons.mean(1, keepdims=True), -5, 5))
        return alpha, beta, gamma, level, trend, seasons

    def run(self, theta: np.ndarray, rows: np.ndarray, ahead: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the series `rows`: residuals whose squares the search adds up, what they are multiples of, forecasts `ahead`."""
        f, y, active = self.form, self.y[rows].T, self.active[rows].T
        alpha, beta, gamma, level, trend, seasons = self.split(theta)
        seasons = None if seasons is None else seasons.T.copy()
        length = len(y)
        fitted, e, future = np.ones_like(y), np.zeros_like(y), np.zeros((ahead, len(theta)))
        for t in range(length + ahead):
            base = level + trend if f.trend == "add" else level * trend if f.trend == "mul" else level
            s = None if seasons is None else seasons[t % f.period]
            mean = base if s is None else base + s if f.season == "add" else base * s
            if t >= length:
                future[t - length], level = mean, base
                continue
            on = active[t]
            error = np.where(on, y[t] - mean, 0.0)
            fitted[t], e[t] = mean, error
            pull = error / np.where(np.abs(s) < TINY, TINY, s) if f.season == "mul" else error
            if f.season:
                by = np.where(np.abs(base) < TINY, TINY, base) if f.season == "mul" else 1.0
                seasons[t % f.period] = s + gamma * error / by
            if f.trend == "mul":
                trend = trend + beta * pull / np.where(np.abs(level) < TINY, TINY, level)
            elif f.trend:
                trend = trend + beta * pull
            level = np.where(on, base + alpha * pull, level)
        unit = np.ones(len(theta))
        if f.error == "mul":
            low = ((fitted <= TINY) & active).any(0)
            fitted = np.where(active & (fitted > TINY), fitted, 1.0)
            unit = np.exp(np.log(fitted).sum(0) / self.n[rows])
            e = e / fitted * unit
            e[:, low] = 1e6  # a mean that is not above 0 has no likelihood
        return np.nan_to_num(np.clip(e, -1e9, 1e9), nan=1e9).T, unit, future.T

    def start(self, weights: tuple[float, float, float]) -> np.ndarray:
        """Parameters to search from: the given weights, the first values, and the mean course of a season."""
        f, y = self.form, self.y
        rows = np.arange(len(y))
        first = y[rows, self.begin]
        some = np.minimum(self.n - 1, 8)
        slope = (y[rows, self.begin + some] - first) / some
        columns = [np.full(len(y), logit(weights[0]))]
        if f.trend:
            columns.append(np.full(len(y), logit(weights[1])))
        if f.season:
            columns.append(np.full(len(y), logit(weights[2])))
        mean = (y * self.active).sum(1) / self.n
        columns.append(mean if f.season else first)
        if f.trend:
            columns.append((np.zeros(len(y)) if f.season else slope) if f.trend == "add" else np.log(np.clip((np.maximum(first, TINY) + slope) / np.maximum(first, TINY), 0.7, 1.4)))
        if f.season:
            for phase in range(f.period):
                on = self.active & (np.arange(y.shape[1]) % f.period == phase)
                at = (y * on).sum(1) / np.maximum(on.sum(1), 1)
                columns.append(at - mean if f.season == "add" else np.log(np.maximum(at, TINY) / np.maximum(mean, TINY)))
        return np.stack(columns, axis=1)

    def search(self) -> tuple[np.ndarray, np.ndarray]:
        """The best parameters of all starts, and their sums of squares."""
        count = len(self.y)
        theta, cost = self.descend(np.concatenate([self.start(w) for w in STARTS]), np.tile(np.arange(count), len(STARTS)))
        best = cost.reshape(len(STARTS), count).argmin(0) * count + np.arange(count)
        return theta[best], cost[best]

    def descend(self, theta: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Levenberg-Marquardt steps until none of a search's last steps gained anything."""
        size, eye = theta.shape[1], np.eye(theta.shape[1])
        r = self.run(theta, rows)[0]
        cost, damp = (r * r).sum(1), np.full(len(theta), 1e-2)
        live = np.arange(len(theta))
        for _ in range(ROUNDS):
            now, of = theta[live], rows[live]
            h = STEP * np.maximum(1.0, np.abs(now))
            moved = now[:, None, :] + h[:, :, None] * eye
            slopes = (self.run(moved.reshape(-1, size), np.repeat(of, size))[0].reshape(len(live), size, -1) - r[live][:, None, :]) / h[:, :, None]
            square, pull = slopes @ slopes.transpose(0, 2, 1), np.einsum("sjt,st->sj", slopes, r[live])
            scale = np.einsum("sii->si", square)
            ridge = (damp[live][:, None] * np.maximum(scale, 1e-9 * (1 + scale.max(1, keepdims=True))))[:, :, None] * eye
            tried = now + np.clip(np.linalg.solve(square + ridge, -pull[:, :, None])[:, :, 0], -10, 10)
            r_tried = self.run(tried, of)[0]
            cost_tried = (r_tried * r_tried).sum(1)
            better = cost_tried < cost[live]
            gain = np.where(better, (cost[live] - cost_tried) / np.maximum(cost[live], TINY), 0.0)
            hit = live[better]
            theta[hit], r[hit], cost[hit] = tried[better], r_tried[better], cost_tried[better]
            damp[live] = np.clip(np.where(better, damp[live] / 4, damp[live] * 6), 1e-9, 1e6)
            live = live[(gain > 1e-8) | (~better & (damp[live] < 1e5))]
            if not len(live):
                break
        return theta, cost


def likelihood(cost: np.ndarray, n: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Twice the negative log-likelihood from a sum of squares over scaled values."""
    return n * (np.log(2 * np.pi * np.maximum(cost / n, TINY)) + 1 + 2 * np.log(scale))


def fitted(series: list[np.ndarray], h: int, period: int = 0) -> dict[str, np.ndarray]:
    """The form of lowest AIC of each series (four points at least) with forecasts, spread and direction."""
    values = [np.maximum(np.nan_to_num(np.asarray(v, float)), 0.0) for v in series]
    length = max(map(len, values))
    y = np.zeros((len(values), length))
    for row, v in zip(y, values):
        row[length - len(v) :] = v
    begin = length - np.array([len(v) for v in values])
    n = length - begin
    scale = np.array([v.mean() for v in values])
    scale = np.where(scale > 0, scale, 1.0)
    positive = np.array([v.min() > 0 for v in values])
    scaled = y / scale[:, None]
    out = {"aic": np.full(len(y), np.inf), "model": np.full(len(y), None, object), "forecast": np.zeros((len(y), h)), "spread": np.zeros((len(y), h))}
    for form in forms(period):
        on = np.flatnonzero(form.fits(n, positive))
        if not len(on):
            continue
        fit = Fit(form, scaled[on], begin[on])
        theta, cost = fit.search()
        aic = likelihood(cost, n[on], scale[on]) + 2 * form.free
        ok = np.isfinite(aic) & (aic < out["aic"][on] - 1e-9)
        rows = np.arange(len(on))
        _, unit, future = fit.run(theta, rows, h)
        future = future * scale[on][:, None]
        alpha, beta, gamma, *_ = fit.split(theta)
        weight = [alpha + beta * j + gamma * (form.season is not None and j % form.period == 0) for j in range(1, h)]
        growth = np.sqrt(1 + np.cumsum([np.zeros(len(on)), *[w * w for w in weight]], axis=0)).T
        sigma = np.sqrt(cost / n[on]) * scale[on]
        if form.error == "mul":  # relative: the residuals carry the geometric mean of the fitted values
            spread = np.abs(future) * (np.sqrt(cost / n[on]) / unit)[:, None] * growth
        else:
            spread = sigma[:, None] * growth
        good = on[ok]
        out["aic"][good], out["model"][good] = aic[ok], form.name
        out["forecast"][good], out["spread"][good] = np.maximum(np.nan_to_num(future[ok]), 0.0), spread[ok]
    last, mean = y[:, -1], np.array([v.mean() for v in values])
    far = (mean > 0) & (np.abs(out["forecast"][:, -1] - last) / np.where(mean > 0, mean, 1.0) > FAR)
    out["direction"] = np.where(~far, "flat", np.where(out["forecast"][:, -1] > last, "up", "down"))
    return out


def ets(series: DataFrame, keys, h: int = 3, period: int = 0, value: str = "v") -> DataFrame:
    """`h` steps of exponential smoothing per series, by the form of lowest AIC, with bands of 80 and 95 %.

    With fewer than 12 points additive errors only, below 18 three forms, else all six forms of error and trend; with a `period`
    and two of them (24 points at least) the eight seasonal forms too. Values below 0 count as 0; multiplicative forms need
    values above 0. Of equal criteria the earlier form wins. `direction` compares the last step with the last value.

    Each series gives `h` rows: with fewer than four points or a null array, forecast and model are null and the direction is
    `short`. Null values count as 0. Bands follow the variance of linear models; those of multiplicative errors are relative.
    """

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            v = [np.array([] if x is None else x, float) for x in rows[value]]
            whole = np.array([len(x) >= LEAST for x in v], bool)
            done = fitted([x for x, ok in zip(v, whole) if ok], h, period) if whole.any() else None
            for step in range(h):
                out = rows[list(keys)].copy()
                out["step"] = np.int32(step + 1)
                for name in ("forecast", *(f"{side}_{b}" for b in BANDS for side in ("low", "high"))):
                    out[name] = np.nan
                out["direction"], out["model"], out["aic"] = "short", None, np.nan
                if done:
                    f, s = done["forecast"][:, step], done["spread"][:, step]
                    out.loc[whole, "forecast"] = f
                    for b, z in BANDS.items():
                        out.loc[whole, f"low_{b}"], out.loc[whole, f"high_{b}"] = np.maximum(f - z * s, 0.0), f + z * s
                    for name in ("direction", "model", "aic"):
                        out.loc[whole, name] = done[name]
                yield out

    kinds = ", ".join(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys)
    found = series.select(*keys, value).mapInPandas(fit, f"{kinds}, step int, forecast double, low_80 double, high_80 double, low_95 double, high_95 double, direction string, model string, aic double")
    return found.replace(float("nan"), None, subset=["forecast", "low_80", "high_80", "low_95", "high_95", "aic"])
