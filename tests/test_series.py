import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelight.config import DetectorConfig
from tidelight.operators import bootstrap, detect, periodic, pulsefit, rebin, skew, timejoin

K = ["source"]


def curve(spark, t, v, e, source="a"):
    pdf = pd.DataFrame({"source": source, "mjd": np.asarray(t, float), "val": np.asarray(v, float), "err": np.asarray(e, float)})
    return spark.createDataFrame(pdf)


def burst(spark, hot, level=5.0, n=200, missing=()):
    t = np.array([i for i in range(n) if i not in missing], float)
    v = np.where(np.isin(t, list(hot)), level, 1.0)
    return curve(spark, 58000.5 + t, v, np.full(len(t), 0.05))


def events(df):
    based = detect.with_baseline(rebin.rebin_series(df, K), K)
    return detect.detect_events(based, K).orderBy("mjd_start").collect()


def test_flat_has_no_events(spark):
    assert events(burst(spark, [])) == []


def test_single_burst(spark):
    (e,) = events(burst(spark, range(50, 70)))
    assert (e.n_points, e.duration_days, e.peak_value, e.peak_mjd) == (20, 19.0, 5.0, 58050.5)


def test_gap_inside_and_gap_break(spark):
    assert len(events(burst(spark, range(50, 70), missing=[58, 59]))) == 1
    assert len(events(burst(spark, range(50, 75), missing=[60, 61, 62, 63, 64]))) == 2


def test_spike_and_short_burst_are_rejected(spark):
    assert events(burst(spark, [80], 50.0)) == []
    assert events(burst(spark, [80, 81, 82])) == []


def test_short_series_is_gated(spark):
    assert events(burst(spark, range(2, 7), n=9)) == []


def test_row_order_partitions_and_other_sources_do_not_matter(spark):
    one = burst(spark, range(50, 70))
    both = one.unionByName(curve(spark, np.arange(30.0), np.random.default_rng(1).normal(9, 1, 30), np.ones(30), "b"))
    want = events(one)
    got = [e for e in events(both.repartition(5).orderBy(F.desc("mjd"))) if e.source == "a"]
    assert got == want


def brute_rebin(t, v, e):
    o = np.argsort(t)
    t, v, e = t[o], v[o], e[o]
    key = np.floor(t) + 0.5 if len(t) > 1 and np.median(np.diff(t)) < 0.5 else t
    w = 1 / np.maximum(e, 1e-8) ** 2
    g = pd.DataFrame({"k": key, "w": w, "wv": w * v}).groupby("k").sum()
    return g.index.to_numpy(), (g.wv / g.w).to_numpy(), np.sqrt(1 / g.w).to_numpy()


@pytest.mark.parametrize("seed", range(4))
def test_rebin_switch_matches_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    frames, want = [], {}
    for s in range(25):
        n = int(rng.integers(1, 12))
        # quarter and half-day grids make ties at the threshold and equal times likely
        t = rng.integers(0, 16, n) * (0.25 if s % 2 else 0.5)
        v, e = rng.normal(5, 1, n), rng.uniform(0.1, 1, n)
        frames.append(pd.DataFrame({"source": str(s), "mjd": t, "val": v, "err": e}))
        want[str(s)] = brute_rebin(t, v, e)
    got = rebin.rebin_series(spark.createDataFrame(pd.concat(frames)), K).toPandas()
    for s, (t, v, e) in want.items():
        g = got[got.source == s].sort_values("mjd")
        assert np.allclose(g.mjd, t) and np.allclose(g.val, v) and np.allclose(g.err, e), s


def test_nearest_ties_tolerance_and_copies(spark):
    left = spark.createDataFrame([("a", 10.0, 1), ("a", 20.0, 2), ("a", 30.0, 3), ("a", 40.0, 4)], "source string, mjd double, lid int")
    right = spark.createDataFrame(
        [("a", 10.5, 7), ("a", 9.5, 9), ("a", 21.0, 3), ("a", 31.0001, 4), ("a", 40.0, 6), ("a", 40.0, 5)],
        "source string, mjd double, rid int",
    )
    got = {r.lid: (r.r_rid, round(r["dt"], 4)) for r in timejoin.nearest_in_time(left, right, K, 1.0, "rid").collect()}
    assert got == {1: (7, 0.5), 2: (3, 1.0), 4: (5, 0.0)}


@pytest.mark.parametrize("slice_days", [0.1, 1.0, 30.0])
def test_nearest_matches_brute_force_for_any_slice(spark, slice_days):
    rng = np.random.default_rng(3)
    lt, rt = np.round(rng.uniform(0, 60, 300), 2), np.round(rng.uniform(0, 60, 80), 2)
    left = spark.createDataFrame(pd.DataFrame({"source": "a", "mjd": lt, "lid": range(300)}))
    right = spark.createDataFrame(pd.DataFrame({"source": "a", "mjd": rt, "rid": range(80)}))
    got = {r.lid: r.r_rid for r in timejoin.nearest_in_time(left, right, K, 0.3, "rid", slice_days).collect()}
    want = {}
    for i, t in enumerate(lt):
        d = np.abs(rt - t)
        if d.min() <= 0.3:
            want[i] = int(np.flatnonzero(d == d.min())[0])
    assert got == want


@pytest.mark.parametrize("budget", [5, 40])
def test_hot_quantiles_equal_plain_ones(spark, budget):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({
        "k": ["hot"] * 3000 + ["one"] * 1 + ["mid"] * 60 + ["same"] * 200,
        "v": np.concatenate([np.round(rng.normal(0, 5, 3000), 2), [4.0], rng.normal(0, 1, 60), np.full(200, 2.5)]),
    })
    df = spark.createDataFrame(pdf)
    probs = {"p10": 0.1, "med": 0.5, "p99": 0.99, "lo": 0.0, "hi": 1.0}
    got = skew.grouped_quantiles(df, ["k"], "v", probs, hot_rows=budget).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        for name, p in probs.items():
            assert got.loc[k, name] == pytest.approx(np.quantile(g.v, p), abs=1e-9), (k, name)


def test_first_per_key_is_the_first(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, o int, v string")
    assert {tuple(r) for r in skew.first_per_key(df, ["k"], F.col("o")).collect()} == {("a", 1, "y"), ("b", 2, "z")}


def brute_detect(t, v, e, base, sig, cfg):
    """Significances of the events of one curve, straight from the rules."""
    cad = np.median(np.diff(t))
    z = (v - base) / sig
    tall = np.where(base > 0, v > cfg.min_ratio * base, v - base > cfg.min_ratio * sig)
    idx = np.flatnonzero((z > cfg.nsigma_exit) & tall)
    out = []
    if idx.size:
        for run in np.split(idx, np.flatnonzero(np.diff(t[idx]) > max(5 * cad, 4.0)) + 1):
            w = 1 / e[run] ** 2
            pooled = np.hypot(np.sqrt(1 / w.sum()), np.median(sig[run]))
            block = ((w * v[run]).sum() / w.sum() - base[run].mean()) / pooled
            if (z[run] > 5).sum() >= 2 and len(run) >= 4 and t[run[-1]] - t[run[0]] >= max(1, 3 * cad) and block > 2.5:
                out.append(z[run].max())
    return out


def test_bootstrap_matches_brute_force(spark):
    cfg = DetectorConfig(n_bootstrap=40)
    rng = np.random.default_rng(8)
    n = 120
    t = 58000.5 + np.arange(n)
    v = 1 + 0.1 * rng.standard_normal(n)
    v[20:44] += 0.9 + 0.1 * rng.standard_normal(24)
    v[80:90] += 0.9
    df = curve(spark, t, v, np.full(n, 0.05))
    based = detect.with_baseline(df, K, cfg)
    ev = detect.detect_events(based, K, cfg)
    got = {r.outburst_id: r.fap_empirical for r in bootstrap.false_alarm(ev, based, K, cfg).collect()}
    p = based.toPandas().sort_values("mjd")
    base, sig, quiet = p.base.to_numpy(), p.sigma.to_numpy(), p.quiet.to_numpy()
    resid = (v - base)[quiet]
    gen = np.random.default_rng(42)
    maxima = []
    for _ in range(40):
        parts, total = [], 0
        while total < n:
            s = gen.integers(0, resid.size - 4 + 1)
            parts.append(resid[s : s + 4])
            total += 4
        maxima.append(max(brute_detect(t, base + np.concatenate(parts)[:n], np.full(n, 0.05), base, sig, cfg), default=0.0))
    want = {r.outburst_id: np.mean(np.array(maxima) >= r.significance_sigma) for r in ev.collect()}
    assert got and got == pytest.approx(want)


def test_period_is_found(spark):
    rng = np.random.default_rng(2)
    t = np.sort(rng.choice(np.arange(400), 300, replace=False)) + 58000.5
    v = 3 + np.sin(2 * np.pi * t / 23.0) + 0.2 * rng.standard_normal(300)
    r = periodic.periodogram(curve(spark, t, v, np.full(300, 0.2)), K).collect()[0]
    assert r.best_period == pytest.approx(23.0, rel=0.02) and r.fap < 1e-6
    # power is the share of the scatter about the mean that a sine with offset explains
    arg = 2 * np.pi * t / r.best_period
    fit = np.stack([np.ones(300), np.cos(arg), np.sin(arg)], 1)
    rest = v - fit @ np.linalg.lstsq(fit, v, rcond=None)[0]
    assert r.power == pytest.approx(1 - (rest @ rest) / ((v - v.mean()) @ (v - v.mean())), abs=1e-9)


def test_regular_spacing(spark):
    ev = spark.createDataFrame([("a", float(x)) for x in (0, 10, 20, 30, 40)] + [("b", 1.0)], "source string, mjd_start double")
    (r,) = periodic.spacing(ev, K, "mjd_start").collect()
    assert (r.source, r.n_events, r.spacing_cv, r.median_gap) == ("a", 5, 0.0, 10.0)


def test_injected_pulse_is_recovered():
    rng = np.random.default_rng(4)
    t = np.arange(58000.5, 58080.5)
    lag = t - 58005.0
    f = np.where(lag > 0, 30 * np.exp(-4.0 / np.maximum(lag, 1e-9) - lag / 15.0), 0.0)
    s = np.maximum(0.02 * f, 0.05)
    r = pulsefit.fit_span(t, f + s * rng.standard_normal(len(t)), s, t[0], t[-1])
    assert 0.6 < r["chi2_red"] < 1.5
    cum = np.cumsum(f)
    true = np.interp(0.95, cum / cum[-1], t) - np.interp(0.05, cum / cum[-1], t)
    assert r["t90"] == pytest.approx(true, rel=0.05)
    assert pulsefit.fit_span(t[:5], f[:5], s[:5], t[0], t[4]) is None


def test_spans_fitted_together_are_those_fitted_alone():
    rng = np.random.default_rng(5)
    spans = []
    for n in (12, 30, 8, 45, 20):
        t = np.sort(rng.choice(60, n, False)) + 0.5
        f = 40.0 * np.exp(-((t - t.mean()) / 6.0) ** 2) + rng.normal(0, 1, n)
        spans.append((t, f, np.ones(n), t[0], t[-1]))
    spans.append((np.arange(12.0), np.zeros(12), np.ones(12), 0.0, 11.0))
    together = pulsefit.fit_spans(spans)
    assert together[2] is None
    for x, got in zip(spans, together):
        alone = pulsefit.fit_span(*x)
        assert (alone is None) == (got is None)
        if alone:
            assert alone["converged"] == got["converged"] and alone["chi2"] == pytest.approx(got["chi2"], rel=1e-6)


def test_a_round_of_the_fit_takes_all_spans(monkeypatch):
    calls, values = [], pulsefit.Curves.values
    monkeypatch.setattr(pulsefit.Curves, "values", lambda self, p: calls.append(len(p)) or values(self, p))
    t = np.arange(20.0)
    f = 30.0 * np.exp(-((t - 8.0) / 3.0) ** 2)
    pulsefit.fit_spans([(t, f, np.ones(20), 0.0, 19.0)])
    alone = len(calls)
    calls.clear()
    pulsefit.fit_spans([(t, f, np.ones(20), 0.0, 19.0)] * 8)
    assert len(calls) == alone and max(calls) == 8


def test_a_span_that_cannot_be_solved_leaves_the_others(monkeypatch):
    t = np.arange(20.0)
    f = 30.0 * np.exp(-((t - 8.0) / 3.0) ** 2)
    solve = np.linalg.solve

    def fails(a, b):
        if len(a) != 4 or a.ndim == 2 and a[0, 0] > 1e5:
            raise np.linalg.LinAlgError("Singular matrix")
        return solve(a, b)

    good, bad = (t, f, np.ones(20), 0.0, 19.0), (t, f, np.full(20, 1e-9), 0.0, 19.0)
    want = pulsefit.fit_span(*good)
    monkeypatch.setattr(np.linalg, "solve", fails)
    got = pulsefit.fit_spans([good, bad, good])
    assert isinstance(got[1], np.linalg.LinAlgError)
    assert all(got[i]["chi2"] == pytest.approx(want["chi2"], rel=1e-6) for i in (0, 2))
