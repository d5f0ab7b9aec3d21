"""Long curves in time segments against windows over whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelight.config import BaselineConfig, DetectorConfig
from tidelight.operators import baseline, detect, segments
from tidelight.plans import population_queries

CFG = DetectorConfig(min_separation_days=0.3, min_duration_days=0.2, cadence_duration_factor=1.0)


def curves(spark, seed=1, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(4):
        t = np.sort(rng.uniform(0, 60, n))
        v = 1 + 0.1 * rng.normal(size=n)
        for a in rng.uniform(2, 55, 6):
            v[(t > a) & (t < a + rng.uniform(0.5, 3))] += rng.uniform(1, 4)
        rows += [(f"s{k}", float(a), float(b), 0.05) for a, b in zip(t, v)]
    rows += [("few", float(i), 1.0, 0.1) for i in range(6)] + [("flat", i / 3, 1.0, 0.1) for i in range(50)]
    return spark.createDataFrame(rows, "source string, mjd double, val double, err double").repartition(4)


def rounded(df):
    return sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("width", [0.7, 9.0])
def test_events_for_any_width(spark, width):
    df = curves(spark)
    based = baseline.baseline_global(detect.long_enough(df, ["source"], CFG.min_series_points), ["source"])
    want = rounded(detect.detect_events(based, ["source"], CFG))
    got = rounded(segments.detect_long_events(df, ["source"], CFG, width=width))
    assert len(want) > 10 and got == want
    points = segments.long_runs(segments.weak_points(df, ["source"], CFG, width=width), ["source"]).where(F.col("n_seed") >= CFG.min_seed_points)
    assert rounded(points.select("source", "mjd", "run", "n_seed")) == rounded(detect.hysteresis_runs(based, ["source"], CFG).select("source", "mjd", "run", "n_seed"))


def test_level_of_hot_series(spark):
    df, cfg = curves(spark, 3).cache(), BaselineConfig(n_iter=1)
    want = rounded(baseline.baseline_global(df, ["source"], cfg).groupBy("source").agg(F.count("*"), F.count_if(F.col("quiet")), F.max("base"), F.max("sigma")))
    for hot in (200, 10_000):
        assert rounded(segments.clipped_level(df, ["source"], cfg, hot_rows=hot)) == want


@pytest.mark.parametrize("width", [0.5, 7.0])
def test_running_sums(spark, width):
    df = curves(spark, 2, 120)
    got = {(r.source, r.mjd): (r.cum, r.total, r.before) for r in segments.running_sum(
        segments.with_previous(df, ["source"], {"before": "val"}, width=width), ["source"], "val", "cum", "total", width=width).collect()}
    for key, part in df.toPandas().sort_values("mjd").groupby("source"):
        cum, before = part.val.cumsum().tolist(), [None, *part.val.tolist()[:-1]]
        for t, c, b in zip(part.mjd, cum, before):
            assert got[key, t] == (pytest.approx(c), pytest.approx(part.val.sum()), b)


def test_fluence_times(spark):
    df = curves(spark, 4, 200)
    got = {r.source: (r.a, r.b) for r in segments.fluence_times(df, ["source"], {"a": 0.05, "b": 0.95}, width=3.0).collect()}
    for key, part in df.toPandas().sort_values("mjd").groupby("source"):
        t, f = part.mjd.to_numpy(), np.maximum(part.val.to_numpy(), 0)
        area = np.concatenate([[0], np.cumsum(0.5 * (f[1:] + f[:-1]) * np.diff(t))])
        assert got[key] == pytest.approx(tuple(np.interp([0.05, 0.95], area / area[-1], t)))


def test_no_window_over_a_series(spark, tmp_path):
    """Rows are windowed within segments; what is windowed by source has a row for each segment or run."""
    plan = segments.stitched_runs(segments.weak_points(curves(spark), ["source"], CFG), ["source"])._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "_seg" not in line.split("windowspecdefinition")[-1].split("mjd")[0]:
            assert "_a#" in line or "_seg#" in line, line


def test_gridded_periodogram_is_the_direct_one(spark):
    from tidelight.config import PeriodConfig
    from tidelight.operators import periodic

    rng = np.random.default_rng(8)
    rows = []
    for k, (n, period) in enumerate([(300, 7.3), (40, 3.1), (150, 23.0), (11, 5.0)]):
        t = np.sort(rng.uniform(0, 40 + 40 * k, n))
        y = 2 + np.sin(2 * np.pi * t / period) + 0.2 * rng.normal(size=n)
        rows += [(k, float(a), float(b), float(e)) for a, b, e in zip(t, y, rng.uniform(0.1, 0.3, n))]
    df = spark.createDataFrame(rows, "source long, mjd double, val double, err double")
    got = {r.source: r for r in periodic.periodogram(df, ["source"]).collect()}
    cfg = PeriodConfig()
    for key, part in df.toPandas().sort_values("mjd").groupby("source"):
        t, y, w = part.mjd.to_numpy(), part.val.to_numpy(), 1 / part.err.to_numpy() ** 2
        w, t = w / w.sum(), t - t[0]
        y = y - (w * y).sum()
        span, cad = t[-1], np.median(np.diff(t))
        fmin, fmax, df_ = 2 / span, 1 / max(cfg.min_period_days, cfg.cadence_factor * cad), 1 / cfg.samples_per_peak / span
        if fmax <= fmin:
            assert key not in got
            continue
        f = fmin + df_ * np.arange(round((fmax - fmin) / df_) + 1)
        c, s = np.cos(2 * np.pi * np.outer(f, t)), np.sin(2 * np.pi * np.outer(f, t))
        C, S, YC, YS = c @ w, s @ w, c @ (w * y), s @ (w * y)
        CC, SS, CS = (c * c) @ w - C * C, (s * s) @ w - S * S, (c * s) @ w - C * S
        power = (SS * YC**2 + CC * YS**2 - 2 * CS * YC * YS) / ((w * y * y).sum() * (CC * SS - CS**2))
        assert got[key].power == pytest.approx(power.max(), abs=1e-12)
        if got[key].best_period is not None:
            assert got[key].best_period == pytest.approx(1 / f[power.argmax()], rel=1e-12)


def test_gridded_power_at_all_frequencies():
    import pandas as pd

    from tidelight.operators import periodic

    rng = np.random.default_rng(2)
    n, steps, df_, fmin = 500, 180, 0.004, 0.04
    t, w, y = rng.uniform(0, 50, n), rng.uniform(0.5, 2, n), rng.normal(size=n)
    w /= w.sum()
    frame = pd.DataFrame({"_series": 1, "_steps": steps, "_fmin": fmin, "_df": df_, "_w": w, "_y": y, "_t": t})
    cells = pd.concat(periodic._spread_points([frame[:200], frame[200:]])).groupby(["_series", "_steps", "_twice", "_cell"], as_index=False).sum()
    size = int(periodic._grid_size(np.array([steps]))[0])
    k = np.arange(steps + 1)
    for twice in (0, 1):
        part = cells[cells._twice == twice]
        grid = np.zeros(size, complex)
        grid[part._cell] = part.wr + 1j * part.wi
        modes = k - size // 4
        got = np.fft.ifft(grid)[modes % size] * np.sqrt(np.pi / periodic._width(size)) * np.exp(modes**2 * periodic._width(size))
        want = np.exp(2j * np.pi * (1 + twice) * np.outer(fmin + df_ * k, t)) @ w
        assert np.abs(got - want).max() < 1e-10


def test_sliding_ranks():
    rng = np.random.default_rng(0)
    held, ranks = [], baseline.SlidingRanks()
    for _ in range(500):
        if held and rng.random() < 0.45:
            v = held.pop(rng.integers(len(held)))
            ranks.drop(v)
        else:
            v = float(rng.integers(0, 20)) if rng.random() < 0.5 else float(rng.normal())
            held.append(v), ranks.add(v)
        if held:
            m = np.median(held)
            assert ranks.median() == m and ranks.median_distance(m) == np.median(np.abs(np.array(held) - m))


@pytest.mark.parametrize("days", [2.0, 13.0])
def test_rolling_level(spark, days):
    df = curves(spark, 6, 150)
    got = {(r.source, r.mjd): (r.base, r.sigma) for r in baseline.baseline_rolling(df, ["source"], days).collect()}
    glob = baseline.baseline_global(df, ["source"]).toPandas()
    assert len(got) == len(glob)
    for r in glob.itertuples():
        near = glob[(glob.source == r.source) & glob.quiet & (glob.mjd >= r.mjd - days / 2) & (glob.mjd <= r.mjd + days / 2)]
        m = near.val.median()
        want = (m, max(1.4826 * (near.val - m).abs().median(), near.err.median())) if len(near) >= 15 else (r.base, r.sigma)
        assert got[r.source, r.mjd] == pytest.approx(want, abs=1e-12)


def test_pulse_fit_tells_how_it_ended(spark):
    df = population_queries.pulse_fit(spark, "/root/testdata/sf0.001")
    assert {"converged", "error"} <= set(df.columns)
