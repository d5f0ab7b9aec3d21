"""Bounded fit of a smeared pulse per (source, band, span).

Spark crops the points to the spans and ships one bounded group per span; the kernel is a
small NumPy least-squares routine that takes many spans at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FitConfig
from .skew import spread
from .timejoin import crop_to_spans

FIT_FIELDS = [
    "baseline", "threshold", "A", "t0", "tau1", "tau2", "width", "t_rise", "t_decay", "chi2", "chi2_red",
    "aic", "t_peak", "t5", "t95", "t90", "resid_mean", "resid_std", "resid_max_abs",
]
#: Grid points that are worked at once: some spans, or one that is larger.
CHUNK_POINTS = 1 << 18


def smeared_pulse(p, grid, step, at) -> np.ndarray:
    """Rise-and-decay pulse averaged over a centred window of odd length, at grid indices.

    One prefix sum over the uniform grid gives the window sum at any index; the pulse is
    zero outside the grid. The width only acts through a whole number of grid
    steps, so the model is flat in it and it has no derivative.
    """
    amp, t0, rise, decay, width = p
    on = int(np.searchsorted(grid, t0, side="right"))
    lag = grid[on:] - t0
    half = max(1, int(round(max(width, step) / step))) // 2
    hi = np.minimum(at + half + 1, len(grid))
    lo = np.maximum(at - half, 0)
    total = np.zeros(len(grid) + 1)
    np.cumsum(np.exp(-rise / lag - lag / decay), out=total[on + 1 :])
    return amp * ((total[hi] - total[lo]) / (2 * half + 1))


class Curves:
    """Smeared pulses of many spans at their data times, all at once: one row for each span.

    Rows are padded to the longest grid and the most points; what is padded gives 0. The width keeps its start
    value, so the window of each data time is fixed. Grid arrays are made once and written over."""

    def __init__(self, spans: list[dict]):
        size = max(len(s["used"]) for s in spans)
        most = max(len(s["t"]) for s in spans)
        self.grid = np.full((len(spans), size), -np.inf)
        self.lo, self.hi = (np.zeros((len(spans), 2 * most), np.int64) for _ in range(2))
        self.share, self.many = np.zeros((len(spans), most)), np.empty((len(spans), 1))
        for i, s in enumerate(spans):
            n = len(s["t"])
            self.grid[i, : len(s["used"])] = s["used"]  # the pulse behind the last window is never summed
            for to, of in zip((self.lo, self.hi), s["window"]):
                to[i, :n], to[i, most : most + n] = of[:n], of[n:]
            self.share[i, :n], self.many[i] = s["share"], s["many"]
        self._scratch()

    def _scratch(self) -> None:
        self.lag, self.shape, *self.work = (np.empty_like(self.grid) for _ in range(5))
        self.off, self.total = np.empty(self.grid.shape, bool), np.zeros((len(self.grid), self.grid.shape[1] + 1))

    def keep(self, rows: np.ndarray) -> None:
        """Leaves the other rows behind."""
        for name in ("grid", "lo", "hi", "share", "many"):
            setattr(self, name, getattr(self, name)[rows])
        self._scratch()

    def _windows(self, part: np.ndarray, lo: np.ndarray, hi: np.ndarray, many: np.ndarray) -> np.ndarray:
        total = self.total[: len(part)]
        np.cumsum(part, axis=1, out=total[:, 1:])
        return (np.take_along_axis(total, hi, 1) - np.take_along_axis(total, lo, 1)) / many

    def _between(self, v: np.ndarray, share: np.ndarray) -> np.ndarray:
        most = share.shape[1]
        return v[:, :most] * (1 - share) + v[:, most:] * share

    def values(self, p: np.ndarray) -> np.ndarray:
        """Values at the data times with the parameters ``p`` of every row."""
        amp, t0, rise, decay = (p[:, [i]] for i in range(4))
        lag, shape, off, more = self.lag, self.shape, self.off, self.work[0]
        np.subtract(self.grid, t0, out=lag)
        np.less_equal(lag, 0, out=off)  # the pulse has not begun, or the grid has ended
        np.copyto(lag, 1.0, where=off)
        np.divide(-rise, lag, out=shape)
        np.divide(lag, decay, out=more)
        np.subtract(shape, more, out=shape)
        np.exp(shape, out=shape)
        np.copyto(shape, 0.0, where=off)
        self.unit = self._windows(shape, self.lo, self.hi, self.many)
        return self._between(amp * self.unit, self.share)

    def slopes(self, p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Derivatives by amplitude, start, rise and decay for ``rows``, at the parameters that :meth:`values` had last."""
        amp, _, rise, decay = (p[rows][:, [i]] for i in range(4))
        inv, first, rest = (w[: len(rows)] for w in self.work)
        lag, shape, share = self.lag[rows], self.shape[rows], self.share[rows]
        window = self.lo[rows], self.hi[rows], self.many[rows]
        out = [self._between(self.unit[rows], share)]
        np.divide(shape, lag, out=inv)
        np.divide(shape, decay, out=first)
        np.multiply(rise, inv, out=rest)
        np.divide(rest, lag, out=rest)
        np.subtract(first, rest, out=first)
        out.append(self._between(amp * self._windows(first, *window), share))
        np.negative(inv, out=inv)
        out.append(self._between(amp * self._windows(inv, *window), share))
        np.multiply(shape, lag, out=rest)
        np.divide(rest, decay**2, out=rest)
        out.append(self._between(amp * self._windows(rest, *window), share))
        return np.stack(out, axis=1)


def bounded_least_squares(spans: list[dict], max_iter: int) -> None:
    """Damped Gauss-Newton inside a box on the parameters that have a derivative, for many spans at once.

    Each span has its points, grid, start ``p`` and box; it gets the parameters, (curve-f)/s and whether no
    step could lower the cost any more before ``max_iter`` steps were done, or the ``failed`` error. Every
    round tries one step of each span; a span goes its own way whatever the others do.
    """
    m, tries = 4, 12
    most = max(len(s["t"]) for s in spans)
    curves = Curves(spans)
    lo, hi = (np.stack([s[k] for s in spans]) for k in ("lo", "hi"))
    p = np.clip(np.stack([s["p"] for s in spans]), lo, hi)
    f, err = np.zeros((len(spans), most)), np.ones((len(spans), most))
    for i, s in enumerate(spans):
        f[i, : len(s["f"])], err[i, : len(s["s"])] = s["f"], s["s"]
    r = (curves.values(p) - f) / err
    n, points = len(spans), np.array([len(s["t"]) for s in spans])
    cost = _squares(r, points)
    damp, steps, tried = np.full(n, 1e-2), np.zeros(n, int), np.zeros(n, int)
    grad, curv, free = np.zeros((n, m)), np.zeros((n, m, m)), np.ones((n, m), bool)
    at, done, rest = np.arange(n), np.full(n, max_iter <= 0), np.zeros(n, bool)
    fresh = np.flatnonzero(~done)  # rows whose derivatives are to be taken
    while True:
        if len(fresh):
            jacs = curves.slopes(p, fresh) / err[fresh][:, None]
            for i, j in zip(fresh, jacs):  # products without the padding, as of a span alone
                j = np.ascontiguousarray(j[:, : points[i]])
                grad[i], curv[i] = j @ r[i, : points[i]], j @ j.T
            x, g = p[fresh][:, :m], grad[fresh]
            free[fresh] = ~(((x <= lo[fresh][:, :m]) & (g > 0)) | ((x >= hi[fresh][:, :m]) & (g < 0)))
            rest[fresh] = done[fresh] = ~free[fresh].any(axis=1)
        live = np.flatnonzero(~done)
        d, failed = _steps(curv[live], grad[live], free[live], damp[live])
        for k, e in failed.items():
            spans[at[live[k]]]["failed"], done[live[k]] = e, True
        if done.sum() > 0.25 * len(done) or done.all():  # rows that came to rest are left behind
            for i in np.flatnonzero(done):
                s = spans[at[i]]
                s.update(p=p[i], r=r[i, : len(s["t"])], converged=bool(rest[i]))
            kept = ~done
            if not kept.any():
                return
            d = d[kept[live]]
            curves.keep(kept)
            at, points, p, lo, hi, f, err, r, cost, damp, steps, tried, grad, curv, free, rest = (
                x[kept] for x in (at, points, p, lo, hi, f, err, r, cost, damp, steps, tried, grad, curv, free, rest))
            done = np.zeros(len(at), bool)
            live = np.arange(len(at))
        elif failed:
            d = d[~done[live]]
            live = live[~done[live]]
        q = p.copy()
        q[live, :m] += d
        q[live] = np.clip(q[live], lo[live], hi[live])
        rq = (curves.values(q) - f) / err
        cq = _squares(rq, points)
        better = ~done & np.isfinite(cq) & (cq < cost)
        gain = np.where(better, cost - cq, 0.0)
        p[better], r[better], cost[better] = q[better], rq[better], cq[better]
        damp = np.where(better, np.maximum(damp / 5, 1e-9), damp * 4)
        tried = np.where(better, 0, tried + 1)
        ended = ~done & (better | (tried >= tries))
        steps += ended
        rest |= ended & (gain <= 1e-7 * np.maximum(cost, 1e-12))
        done |= ended & (rest | (steps >= max_iter))
        fresh = np.flatnonzero(ended & ~done)


def _squares(r: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Sum of squares of each row, without its padding."""
    return np.array([x[:n] @ x[:n] for x, n in zip(r, points.tolist())])


def _steps(curv: np.ndarray, grad: np.ndarray, free: np.ndarray, damp: np.ndarray) -> tuple[np.ndarray, dict]:
    """Damped steps on the free parameters, and the errors of rows that cannot be solved."""
    each = np.arange(curv.shape[1])
    a, d, failed = curv.copy(), np.zeros_like(grad), {}
    a[:, each, each] += damp[:, None] * np.maximum(a[:, each, each], 1e-12)
    whole = free.all(axis=1)
    try:
        d[whole] = np.linalg.solve(a[whole], -grad[whole][..., None])[..., 0]
    except np.linalg.LinAlgError:  # one of them: find which
        whole[:] = False
    for k in np.flatnonzero(~whole):
        f = free[k]
        try:
            d[k, f] = np.linalg.solve(a[k][np.ix_(f, f)], -grad[k, f])
        except np.linalg.LinAlgError as e:
            failed[k] = e
    return d, failed


def _start(t, f, s, t_start, t_end, cfg: FitConfig) -> dict:
    """Grid, start values and box of the fit of one span."""
    peak = int(np.argmax(f))
    cad = float(np.median(np.diff(t))) if len(t) > 1 else 1.0
    w0, span = max(cad, 0.3), max(t_end - t_start, 1.0)
    w_hi = max(0.5 * span, 5 * w0)
    step = max(span / 3000.0, 0.02)
    pad = max(2 * w_hi, 15.0)
    grid = np.arange(t_start - pad, t_end + pad + step, step)
    # only grid points that a smeared value at a data time can depend on
    reach = 0.5 * w_hi + 3 * step
    grid = grid[(grid >= t[0] - reach) & (grid <= t[-1] + reach)]
    guess = np.array(
        [1.5 * max(f[peak], 1e-6), np.clip(t[peak] - 5.0, t[0] - 50, t[peak] - 0.5), 2.0, 20.0, w0]
    )
    lo = np.array([0.0, t[0] - 100, 0.01, 0.1, 0.01])
    hi = np.array([np.inf, t[peak], 500.0, 1000.0, w_hi])
    ref = grid[0]
    shift = np.array([0, ref, 0, 0, 0.0])
    grid = grid - ref

    def at(times):
        """Grid point before each time, and its share of the way to the next one."""
        left = np.clip(np.floor((times - ref) / step).astype(int), 0, len(grid) - 2)
        return left, (times - ref - grid[left]) / step

    left, share = at(t)
    both = np.concatenate([left, left + 1])
    half = max(1, int(round(max(np.clip(w0, lo[4], hi[4]), step) / step))) // 2
    begin, end = np.maximum(both - half, 0), np.minimum(both + half + 1, len(grid))
    return dict(
        t=t, f=f, s=s, grid=grid, ref=ref, step=step, at=at, w_hi=w_hi, p=guess - shift, lo=lo - shift, hi=hi - shift,
        used=grid[: end.max()], window=(begin, end), share=share, many=2 * half + 1,
    )


def _summary(x: dict, cfg: FitConfig) -> dict:
    """All summary numbers of a fitted span."""
    t, s, p, r, ref = x["t"], x["s"], x["p"], x["r"], x["ref"]
    resid = -r * s
    chi2, k, n = float(r @ r), 5, len(t)
    out = dict(
        A=p[0], t0=p[1] + ref, tau1=p[2], tau2=p[3], width=p[4], t_rise=p[2], t_decay=p[3], chi2=chi2,
        dof=n - k, chi2_red=chi2 / (n - k) if n > k else np.inf,
        aic=chi2 + 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1),
        resid_mean=resid.mean(), resid_std=resid.std(), resid_max_abs=np.abs(resid).max(),
        converged=x["converged"], resid_sigma=(resid / s).tolist(), width_max=x["w_hi"],
    )
    fine = np.linspace(t[0], t[-1], cfg.shape_grid)
    left, share = x["at"](fine)
    v = smeared_pulse(p, x["grid"], x["step"], np.concatenate([left, left + 1]))
    g = np.clip(v[: len(fine)] * (1 - share) + v[len(fine) :] * share, 0, None)
    area = np.concatenate([[0.0], np.cumsum(0.5 * (g[1:] + g[:-1]) * np.diff(fine))])
    if g.max() > 0 and area[-1] > 0:
        t5, t95 = np.interp([0.05, 0.95], area / area[-1], fine)
        out.update(t_peak=fine[int(np.argmax(g))] - out["t0"], t5=t5, t95=t95, t90=t95 - t5)
    return out


FAILURES = (np.linalg.LinAlgError, ValueError, FloatingPointError)


def fit_spans(points: list[tuple], cfg: FitConfig = FitConfig()) -> list:
    """:func:`fit_span` of many (t, f, s, t_start, t_end); an error stands in the place of a span that has it.

    Spans of like size are fitted together, a bounded number at a time."""
    out: list = [None] * len(points)
    begun = {}
    for i, x in enumerate(points):
        if len(x[0]) >= cfg.min_points:
            try:
                begun[i] = _start(*x, cfg)
            except FAILURES as e:
                out[i] = e
    weight = {i: len(x["used"]) + 2 * len(x["t"]) for i, x in begun.items()}
    order, k = sorted(begun, key=lambda i: -weight[i]), 0
    while k < len(order):
        some = order[k : k + max(1, CHUNK_POINTS // weight[order[k]])]
        k += len(some)
        with np.errstate(all="ignore"):
            bounded_least_squares([begun[i] for i in some], cfg.max_iter)
        for i in some:
            try:
                out[i] = begun[i].get("failed") or _summary(begun[i], cfg)
            except FAILURES as e:
                out[i] = e
            del begun[i]
    return out


def fit_span(t, f, s, t_start, t_end, cfg: FitConfig = FitConfig()) -> dict | None:
    """All summary numbers of one span (time-ordered points), None if too few points."""
    found = fit_spans([(t, f, s, t_start, t_end)], cfg)[0]
    if isinstance(found, Exception):
        raise found
    return found


def fit_pulses(
    series: DataFrame, spans: DataFrame, keys: Sequence[str], cfg: FitConfig = FitConfig()
) -> DataFrame:
    """One row per (keys, outburst_idx) with at least ``min_points`` points in the span.

    ``converged`` tells whether the fit came to rest within ``max_iter`` steps, ``error`` why a
    span has no fit, ``resid_sigma`` the residuals in units of the errors, in time order.
    The width is a fifth parameter of the model and counts in ``dof``, though the smeared curve
    is flat in it below one grid step.

    ``series``: keys, mjd, val, err plus per-series ``baseline`` and ``threshold``.
    """
    ids = [*keys, "outburst_idx"]
    good = series.where("err > 0 AND abs(val) < double('inf') AND abs(err) < double('inf')")
    pts = crop_to_spans(good, spans, list(keys))
    rows = pts.groupBy(*ids, "baseline", "threshold", "t_start", "t_end").agg(
        F.sort_array(F.collect_list(F.struct("mjd", "val", "err"))).alias("_p"), F.count("*").alias("n_points")
    )
    # too small spans never reach Python
    rows = rows.where(F.col("n_points") >= cfg.min_points).select(
        *ids, "baseline", "threshold", F.col("t_start").alias("span_start_mjd"),
        F.col("t_end").alias("span_end_mjd"), "n_points", "_p.mjd", "_p.val", "_p.err",
    )
    copied = [*ids, "baseline", "threshold", "span_start_mjd", "span_end_mjd", "n_points"]
    fitted = [*[c for c in FIT_FIELDS if c not in copied], "width_max"]
    out = T.StructType(
        [rows.schema[c] for c in copied]
        + [T.StructField("dof", T.LongType()), T.StructField("converged", T.BooleanType()), T.StructField("error", T.StringType()),
           T.StructField("resid_sigma", T.ArrayType(T.DoubleType()))]
        + [T.StructField(c, T.DoubleType()) for c in fitted]
    )

    def run(batches):
        for pdf in batches:
            points = [
                (*(np.asarray(x) for x in (r.mjd, r.val, r.err)), r.span_start_mjd, r.span_end_mjd) for r in pdf.itertuples(index=False)
            ]
            res = [{"error": f"{type(x).__name__}: {x}"} if isinstance(x, Exception) else x for x in fit_spans(points, cfg)]
            done = pd.DataFrame({c: [x.get(c, np.nan) for x in res] for c in fitted}, index=pdf.index)
            done.insert(0, "dof", pd.array([x.get("dof") for x in res], "Int64"))
            for i, c in enumerate(["converged", "error", "resid_sigma"]):
                done.insert(i + 1, c, pd.Series([x.get(c) for x in res], index=pdf.index, dtype=object))
            yield pd.concat([pdf[copied], done], axis=1)

    return spread(rows).mapInPandas(run, out)


def curve_of_fit(p, t_start: float, t_end: float, width_max: float, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Times and values of a fitted pulse at ``points`` even times of its span, on the grid of the fit."""
    step = max(max(t_end - t_start, 1.0) / 3000.0, 0.02)
    pad = max(2 * width_max, 15.0)
    grid = np.arange(t_start - pad, t_end + pad + step, step)
    times = np.linspace(t_start, t_end, points)
    left = np.clip(np.floor((times - grid[0]) / step).astype(int), 0, len(grid) - 2)
    share = (times - grid[0] - (grid[left] - grid[0])) / step
    value = smeared_pulse(np.asarray(p) - [0, grid[0], 0, 0, 0], grid - grid[0], step, np.concatenate([left, left + 1]))
    return times, value[:points] * (1 - share) + value[points:] * share


CURVE = "mjd double, model double, in_t90 boolean, is_peak boolean"


def fitted_curves(fits: DataFrame, keys: Sequence[str], points: int = 3000) -> DataFrame:
    """The fitted pulses as rows: keys, outburst_idx, point (from 1), mjd, model, in_t90, is_peak, baseline, threshold.

    A table function is joined laterally with the fits; it yields the rows of one fit one after another,
    so a task holds one curve at a time. The peak is the first of equal highest points. Spans without a
    fit have no rows."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=f"point long, {CURVE}")
    class Curve:
        def eval(self, amp, t0, rise, decay, width, width_max, t_start, t_end, t5, t95, points):
            times, model = curve_of_fit([amp, t0, rise, decay, width], t_start, t_end, width_max, points)
            top = int(np.argmax(model))
            for i, (t, v) in enumerate(zip(times.tolist(), model.tolist())):
                yield i + 1, t, v, t5 is not None and t5 <= t <= t95, i == top

    ids = [*keys, "outburst_idx"]
    good = fits.where("error IS NULL AND A IS NOT NULL AND NOT isnan(A)").select(
        *ids, "baseline", "threshold", "A", "t0", "tau1", "tau2", "width", "width_max", "span_start_mjd", "span_end_mjd",
        *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("t5", "t95")])
    outer = [F.col(c).outer() for c in ("A", "t0", "tau1", "tau2", "width", "width_max", "span_start_mjd", "span_end_mjd", "t5", "t95")]
    rows = spread(good).lateralJoin(Curve(*outer, F.lit(points)))
    return rows.select(*ids, "point", "mjd", "model", "in_t90", "is_peak", "baseline", "threshold")
