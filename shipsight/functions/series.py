"""Figures of monthly series at many cut-offs, computed over whole batches of series.

A series is one row of arrays, bounded by the calendar, so that a cut-off costs a pass over arrays in memory and no row is
repeated for each cut-off. Nulls travel as NaN.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def percentile(values: np.ndarray, owner: np.ndarray, n: int, prob: np.ndarray | float) -> np.ndarray:
    """Linear-interpolated quantile per owner; values are sorted by (owner, value). NaN without values."""
    count = np.bincount(owner, minlength=n)
    start = np.cumsum(count) - count
    at = (count - 1) * np.broadcast_to(np.asarray(prob, float), (n,))
    lo, hi = np.floor(at), np.ceil(at)
    out, has = np.full(n, NAN), count > 0
    a, b = (values[(start + x.astype(int))[has]] for x in (lo, hi))
    out[has] = np.where((lo[has] == hi[has]) | (a == b), a, (hi[has] - at[has]) * a + (at[has] - lo[has]) * b)
    return out


class Series:
    """A batch of series end to end: rows sorted by (series, month), `owner` is the series of a row."""

    def __init__(self, batch: pa.RecordBatch):
        months = batch.column("month_idx")
        size = months.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.n, self.size = len(size), size
        self.start = np.cumsum(size) - size
        self.owner = np.repeat(np.arange(self.n), size)
        self.month = months.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.qty, self.rev, self.profit, self.top = (self._floats(batch.column(c)) for c in ("qty", "rev_pos", "profit", "max_row_qty"))
        self.new = batch.column("is_new").flatten().fill_null(False).to_numpy(zero_copy_only=False)
        with np.errstate(divide="ignore", invalid="ignore"):
            margin = np.where(self.rev != 0, self.profit / self.rev, NAN)
            price = np.where(self.qty != 0, self.rev / self.qty, NAN)
        self.price = np.where(price > 0, price, NAN)
        # Positive margins in the order of (series, margin), each with its place among the series' positive margins by month.
        positive = np.flatnonzero(margin > 0)
        place = np.cumsum(margin > 0) - np.repeat(self._before(margin > 0), size)
        positive = positive[np.lexsort((margin[positive], self.owner[positive]))]
        self.m_owner, self.m_month, self.m, self.m_place = self.owner[positive], self.month[positive], margin[positive], place[positive]
        known = np.flatnonzero(~np.isnan(self.qty))
        known = known[np.lexsort((self.qty[known], self.owner[known]))]
        self.q_owner, self.q_month, self.q = self.owner[known], self.month[known], self.qty[known]
        # How many falls in a row end at each row.
        fell = np.zeros(len(self.month), bool)
        fell[1:] = self.qty[1:] < self.qty[:-1]
        fell[self.start] = False
        at = np.arange(len(fell))
        self.falls = at - np.maximum.accumulate(np.where(fell, 0, at))
        # Rows up to each month, and running counts and sums over all rows.
        self.first = int(self.month.min())
        span = int(self.month.max()) - self.first + 1
        self.upto = np.zeros((self.n, span + 1), np.int64)
        self.upto[:, 1:] = np.bincount(self.owner * span + self.month - self.first, minlength=self.n * span).reshape(self.n, span).cumsum(1)
        self.new_before, self.sold_before = (np.concatenate([[0], np.cumsum(x)]) for x in (self.new, self.qty > 0))
        self.totals = {s: self._sums(x) for x, s in ((self.qty, "q"), (self.rev, "r"), (self.profit, "p"))}

    @staticmethod
    def _floats(column: pa.Array) -> np.ndarray:
        return column.flatten().cast(pa.float64()).fill_null(NAN).to_numpy(zero_copy_only=False)

    def _before(self, flag: np.ndarray) -> np.ndarray:
        """Flagged rows ahead of each series."""
        return np.concatenate([[0], np.cumsum(flag)])[self.start]

    def until(self, t: int) -> np.ndarray:
        """The end of each series' rows up to a month."""
        return self.start + self.upto[:, min(max(t - self.first, -1) + 1, self.upto.shape[1] - 1)]

    @staticmethod
    def _sums(x: np.ndarray):
        """Sums of the known values between rows: exact by whole ten-thousandths, else by adding up."""
        x = np.nan_to_num(x)
        cents = np.rint(x * 1e4)
        if len(x) * np.abs(cents).max(initial=0) < 2**62 and (cents / 1e4 == x).all():
            run = np.concatenate([[0], np.cumsum(cents.astype(np.int64))])
            return lambda lo, hi: (run[hi] - run[lo]) / 1e4
        x = np.append(x, 0.0)
        return lambda lo, hi: np.where(hi > lo, np.add.reduceat(x, np.column_stack([lo, hi]).ravel())[::2], 0.0)

    def slope(self, place: np.ndarray, owner: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of values, their least squares slope over the place, and their mean, per owner."""
        known = ~np.isnan(y)
        x, owner, y = place[known].astype(float), owner[known], y[known]
        total = lambda v: np.bincount(owner, v, self.n)
        n = np.bincount(owner, minlength=self.n)
        with np.errstate(divide="ignore", invalid="ignore"):
            my = total(y) / n
            dx = x - (total(x) / n)[owner]
            sxx = total(dx * dx)
            return n, total(dx * (y - my[owner])) / np.where(sxx > 0, sxx, NAN), my

    def base(self, t: int, windows: dict[str, tuple[int, int]], bulk: float) -> dict[str, np.ndarray]:
        """Ages, flags and sums of windows of the months up to a cut-off, one value per series."""
        now, year = self.until(t), self.until(t - 12)
        first = self.month[self.start]
        out = {
            "first_idx": first, "last_idx": self.month[np.maximum(now - 1, self.start)], "active_months": now - self.start, "age": t - first + 1, "first_bulk_idx": np.where(self.bulk(bulk) <= t, self.bulk(bulk), NAN),
            "is_new": self.new_before[now] > self.new_before[year], "active_24m": self.sold_before[now] - self.sold_before[self.until(t - 24)], "end": np.maximum(now - 1, self.start),
        }
        for w, (n, skip) in windows.items():
            lo, hi = self.until(t - skip - n), self.until(t - skip)
            out |= {f"{w}_{s}": total(lo, hi) for s, total in self.totals.items()}
            out[f"{w}_m"] = hi - lo
        return out

    def bulk(self, least: float) -> np.ndarray:
        """First month with a row of that quantity."""
        return np.minimum.reduceat(np.where(self.top >= least, self.month.astype(float), np.inf), self.start)

    def at(self, t: int, windows: dict[str, tuple[int, int]], bulk: float) -> dict[str, np.ndarray]:
        """All figures of the months up to a cut-off, one value per series."""
        out = self.base(t, windows, bulk)
        age, n_of = out["age"], self.n
        # Reference margins: the quantile depends on age and depth, the long one takes the newest 24 positive months.
        now = self.m_month <= t
        owner, m = self.m_owner[now], self.m[now]
        n = np.bincount(owner, minlength=n_of)
        prob = np.select([(age < 12) & (n < 6), age < 12, n >= 20], [0.30, 0.50, 0.95], 0.90)
        newest = self.m_place[now] > (n - 24)[owner]
        out |= {"hist_margin": np.where(n == 0, 0.0, percentile(m, owner, n_of, prob)), "long_margin": np.where(age >= 36, percentile(m[newest], owner[newest], n_of, 0.8), NAN), "no_hist": n == 0}
        year = np.flatnonzero((self.month <= t) & (self.month > t - 12))
        half = year[self.month[year] > t - 6]
        y_of, h_of = self.owner[year], self.owner[half]
        gain = np.maximum(np.nan_to_num(self.profit[half]), 0.0)
        points, s, mean = self.slope(half - self.until(t - 6)[h_of] + 1, h_of, gain)
        top = np.full(n_of, NAN)
        np.fmax.at(top, h_of, gain)
        out |= {"slope_points": points, "_ps": s, "_pm": mean, "_pt": top}
        # Volatility of the 12 months' quantities.
        q_in = (self.q_month <= t) & (self.q_month > t - 12)
        q, q_of = self.q[q_in], self.q_owner[q_in]
        med = percentile(q, q_of, n_of, 0.5)
        off = np.abs(q - med[q_of])
        order = np.lexsort((off, q_of))
        known = np.bincount(q_of, minlength=n_of)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = out["r12_q"] / known
            sd = np.sqrt(np.bincount(q_of, (q - mean[q_of]) ** 2, n_of) / np.where(known > 1, known - 1, NAN))
        out |= {"_vq": np.where(known > 0, out["r12_q"], NAN), "_vmean": mean, "_vsd": sd, "_vmed": med, "_vmad": percentile(off[order], q_of[order], n_of, 0.5), "_vact": np.bincount(q_of[q > 0], minlength=n_of)}
        out["consecutive_falls"] = np.minimum(self.falls[out["end"]], 12)
        n, s, mean = self.slope(year - self.until(t - 12)[y_of] + 1, y_of, self.price[year])
        return out | {"_an": n, "_as": s, "_am": mean}


def _arrow(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    if values.dtype.kind == "f":
        return pa.array(values, mask=np.isnan(values)).cast(kind)
    return pa.array(values).cast(kind)


def series(pm: DataFrame) -> DataFrame:
    """One row of arrays per product, by month. Category and line are arrays of their greatest value so far, if it changes."""
    figures = ["month_idx", "qty", "rev_pos", "profit", "max_row_qty", "is_new"]
    rows = pm.filter(F.col("product_id").isNotNull() & F.col("month_idx").isNotNull()).withColumn("max_row_qty", F.col("max_row_qty").cast("double"))
    texts = ["category", "product_line"]
    same = lambda c: (F.min(c) == F.max(c)) & (F.count(c) == F.count("*"))
    g = rows.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct(*figures, *texts))).alias("s"), *[F.max(c).alias(c) for c in texts], *[same(c).alias(f"_{c}") for c in texts])
    # The greatest so far: of each month and those before it.
    so_far = lambda c: F.transform(F.col(f"s.{c}"), lambda x, i: F.array_max(F.slice(F.col(f"s.{c}"), 1, i + 1)))
    return g.select("product_id", *[F.col(f"s.{c}").alias(c) for c in figures], *texts, *[F.when(~F.coalesce(f"_{c}", F.lit(False)), so_far(c)).alias(f"{c}_so_far") for c in texts])


def at_cutoffs(rows: DataFrame, cutoffs, windows: dict[str, tuple[int, int]], min_age: int, bulk: float, whole: bool = True) -> DataFrame:
    """Each series at each cut-off where it has the age, with all figures of `Series.at` and the shares of customers.

    Not `whole`: those of `Series.base` only, over the one-year window.
    """
    cutoffs = [int(t) for t in cutoffs]
    windows = windows if whole else {"r12": windows["r12"]}
    ints = {"as_of": "int", "first_idx": "int", "last_idx": "int", "active_months": "bigint", "age": "int", "first_bulk_idx": "int", "is_new": "boolean", "active_24m": "bigint", "slope_points": "bigint", "consecutive_falls": "int", "no_hist": "boolean", "_an": "bigint", "_vact": "bigint"}
    ints |= {f"{w}_m": "bigint" for w in windows}
    doubles = [f"{w}_{s}" for w in windows for s in "qrp"] + ["hist_margin", "long_margin", "_ps", "_pm", "_pt", "_vq", "_vmean", "_vsd", "_vmed", "_vmad", "_as", "_am"]
    if not whole:
        ints = {c: k for c, k in ints.items() if c not in ("slope_points", "consecutive_falls", "no_hist", "_an", "_vact")}
        doubles = [f"r12_{s}" for s in "qrp"]
    texts = ["category", "product_line"]
    id_type = dict(rows.dtypes)["product_id"]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
    fields = [("product_id", id_type), *ints.items(), *[(d, "double") for d in doubles], *[(c, "string") for c in texts], *[(c, "double") for c in ("top1", "top3") if whole]]

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = Series(batch)
            text = {c: (batch.column(c), batch.column(f"{c}_so_far")) for c in texts}
            lists_at = {c: np.cumsum(n := lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) - n for c, (_, lists) in text.items()}
            for i, t in enumerate(cutoffs):
                x = (s.at if whole else s.base)(t, windows, bulk)
                keep = np.flatnonzero(x["age"] >= min_age)
                if not len(keep):
                    continue
                at = pa.array(keep)
                columns = [batch.column("product_id").take(at)]
                x["as_of"] = np.full(s.n, t)
                columns += [_arrow(x[c][keep], kinds[k]) for c, k in ints.items()]
                columns += [_arrow(x[c][keep].astype(float), pa.float64()) for c in doubles]
                for c, (greatest, lists) in text.items():
                    varies = lists.is_valid().to_numpy(zero_copy_only=False)[keep]
                    place = lists_at[c][keep] + x["end"][keep] - s.start[keep]
                    flat = lists.flatten().take(pa.array(np.where(varies, place, 0), mask=~varies)) if varies.any() else None
                    one = greatest.take(at)
                    columns.append(one if flat is None else pc.if_else(pa.array(varies), flat, one))
                for c in ("top1", "top3") if whole else ():
                    share = batch.column(c)
                    known = share.is_valid().to_numpy(zero_copy_only=False)[keep]
                    before = np.cumsum(n := share.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) - n
                    columns.append(share.flatten().take(pa.array(np.where(known, before[keep] + i, 0), mask=~known)) if known.any() else pa.nulls(len(keep), pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, [f for f, _ in fields])

    return rows.mapInArrow(figures, ", ".join(f"`{f}` {k}" for f, k in fields))


def _runs(*columns: pa.Array) -> np.ndarray:
    """Where a run of equal keys begins; nulls are equal to each other."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        a, b = x.slice(1), x.slice(0, len(x) - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _customer_sums(rows: pa.Table, cutoffs: list[int], months: int) -> tuple[pa.Array, np.ndarray]:
    """Per product and cut-off: total, customers, customers with a sum, and the three greatest sums (NaN where fewer)."""
    pair, product = _runs(rows["product_id"].chunk(0), rows["customer_id"].chunk(0)), _runs(rows["product_id"].chunk(0))
    month = rows["month_idx"].to_numpy()
    is_known, value = rows["cents"].is_valid().to_numpy(), rows["cents"].fill_null(0).to_numpy()
    of = np.searchsorted(product, pair, side="right") - 1
    out = np.zeros((len(product), len(cutoffs), 6))
    for i, t in enumerate(cutoffs):
        inside = (month <= t) & (month > t - months)
        known = inside & is_known
        there, has = (np.add.reduceat(m.astype(np.int64), pair) > 0 for m in (inside, known))
        v = np.add.reduceat(np.where(known, value, 0), pair) / 1e4
        out[:, i, 1] = np.bincount(of[there], minlength=len(product))
        n = np.bincount(of[has], minlength=len(product))
        out[:, i, 0], out[:, i, 2] = np.bincount(of[has], v[has], len(product)), n
        sums = v[has][np.lexsort((-v[has], of[has]))]
        begin = np.cumsum(n) - n
        for rank in range(3):
            out[:, i, 3 + rank] = NAN
            deep = n > rank
            out[deep, i, 3 + rank] = sums[begin[deep] + rank]
    return rows["product_id"].chunk(0).take(pa.array(product)), out


def customer_shares(cpm: DataFrame, cutoffs, months: int = 12) -> DataFrame:
    """Per product, arrays over the cut-offs: the share of the greatest customer and of the three greatest in the months before.

    Rows of a product stream through one task by customer; of a product only sums are kept between batches. NULL without rows.
    Revenue is summed as whole ten-thousandths, so that what cancels out is zero.
    """
    cutoffs = [int(t) for t in cutoffs]
    seen = F.lit(False)
    for t in cutoffs:
        seen = seen | ((F.col("month_idx") <= t) & (F.col("month_idx") > t - months))
    rows = cpm.filter(F.col("product_id").isNotNull() & seen).select("product_id", "customer_id", "month_idx", (F.col("revenue").cast("decimal(22,4)") * 10000).cast("bigint").alias("cents"))

    def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        best = -np.sort(-np.concatenate([a[:, 3:], b[:, 3:]], axis=1), axis=1)[:, :3]  # NaN last
        return np.concatenate([a[:, :3] + b[:, :3], best], axis=1)

    def result(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        total, n, known, best = x[..., 0], x[..., 1], x[..., 2], x[..., 3:]
        t = np.where(known > 0, total, NAN)
        with np.errstate(divide="ignore", invalid="ignore"):
            top1 = np.where(t == 0, 0.0, best[..., 0] / t)
            top3 = np.where(t == 0, 0.0, np.where(n < 3, 1.0, np.nansum(best, axis=-1) / t))
        top1 = np.where(np.isnan(top1), 0.0, top1)
        lists = []
        for share in (top1, top3):
            share = np.where(n > 0, share, NAN).ravel()
            lists.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(share) + 1, len(cutoffs)), pa.int32()), _arrow(share, pa.float64())))
        return pa.RecordBatch.from_arrays([ids, *lists], ["product_id", "top1", "top3"])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, open_id, open_x = None, None, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (rows if rest is None else pa.concat_tables([rest, rows])).combine_chunks()
            if not rows.num_rows:
                continue
            cut = int(_runs(rows["product_id"].chunk(0), rows["customer_id"].chunk(0))[-1])
            rest, rows = rows.slice(cut).combine_chunks(), rows.slice(0, cut).combine_chunks()
            if not rows.num_rows:
                continue
            ids, x = _customer_sums(rows, cutoffs, months)
            if open_id is not None and ids[0] == open_id[0]:
                x[0] = merged(open_x[0], x[0])
            elif open_id is not None:
                yield result(open_id, open_x)
            open_id, open_x = ids.slice(len(ids) - 1), x[-1:]
            if len(ids) > 1:
                yield result(ids.slice(0, len(ids) - 1), x[:-1])
        if rest is not None and rest.num_rows:
            ids, x = _customer_sums(rest, cutoffs, months)
            if open_id is not None and ids[0] == open_id[0]:
                x[0] = merged(open_x[0], x[0])
            elif open_id is not None:
                yield result(open_id, open_x)
            yield result(ids, x)

    # The rows are of one task's products; a chunk holds at most a batch and the rest of one customer.
    sorted_rows = rows.repartition("product_id").sortWithinPartitions("product_id", "customer_id", "month_idx")
    return sorted_rows.mapInArrow(shares, f"product_id {dict(rows.dtypes)['product_id']}, top1 array<double>, top3 array<double>")
