"""Recurrence: spacing regularity, floating-mean periodogram, combined decision.

Inputs are rebinned series and their events, both bounded per series by the time span.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PeriodConfig
from ..functions.expr import inv_var
from ..session import cut_lineage
from .detect import cadence
from .skew import join_small

#: Half width, in cells, of the Gaussian that spreads a point on the grid: 24 cells, 12 digits.
SPREAD = 12
#: Frequencies whose gridded power is this close to the best are computed again from the points.
CLOSE = 1e-7


def spacing(events: DataFrame, keys: Sequence[str], start: str, cfg: PeriodConfig = PeriodConfig()) -> DataFrame:
    """Per key with enough events: n_events, spacing_cv (population), median_gap."""
    ordered = Window.partitionBy(*keys).orderBy(start)
    df = events.withColumn("_gap", F.col(start) - F.lag(start).over(ordered))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n_events"), F.count("_gap").alias("_ng"), F.avg("_gap").alias("_mean"),
        F.stddev_pop("_gap").alias("_sd"), F.median("_gap").alias("median_gap"),
    )
    ok = (F.col("_mean") > 0) & (F.col("_ng") > 1)
    return out.where(F.col("n_events") >= cfg.min_events).select(
        *keys, "n_events", F.when(ok, F.try_divide("_sd", "_mean")).alias("spacing_cv"), "median_gap"
    )


def periodogram(series: DataFrame, keys: Sequence[str], cfg: PeriodConfig = PeriodConfig(), cadences: DataFrame | None = None) -> DataFrame:
    """Best period per series: keys, best_period, power, fap; NULL period where the peak
    lies within the guarded edge of the frequency range or no range is left.

    Floating-mean least-squares power with 1/err^2 weights, on a regular frequency grid of
    ``samples_per_peak`` steps per 1/span. Points are spread on a grid with a Gaussian and added up
    by cell; a transform of a series' cells gives the power at all frequencies, and the
    ones that can be the best are computed exactly from the points. Rows are linear in points plus
    frequencies, and only cells, as many as a few times the frequencies, meet in one task.

    ``cadences`` (keys, cadence) spares the window over each series, for curves that are not bounded.
    """
    paced = cadence(series, keys) if cadences is None else join_small(series, cadences, keys)
    df = cut_lineage(paced.withColumn("_w0", inv_var(F.col("err"))))
    const = df.groupBy(*keys).agg(
        F.sum("_w0").alias("_sw"), F.min("mjd").alias("_t0"), (F.max("mjd") - F.min("mjd")).alias("_span"), F.count("*").alias("_n"),
        F.avg("mjd").alias("_tm"), (F.sum(F.col("_w0") * F.col("val")) / F.sum("_w0")).alias("_ym"), F.max("cadence").alias("_cad"),
    )
    const = const.withColumn("_fmin", F.try_divide(F.lit(2.0), "_span")).withColumn(
        "_fmax", 1.0 / F.greatest(F.lit(cfg.min_period_days), cfg.cadence_factor * F.col("_cad"))
    ).withColumn("_df", F.try_divide(F.lit(1.0 / cfg.samples_per_peak), "_span"))
    steps = F.bround((F.col("_fmax") - F.col("_fmin")) / F.col("_df")).cast("int")
    const = cut_lineage(const.where(F.col("_fmax") > F.col("_fmin")).withColumn("_steps", steps).withColumn("_series", F.monotonically_increasing_id()))
    points = cut_lineage(join_small(df.select(*keys, "mjd", "val", "_w0"), const, keys).select(
        "_series", "_steps", "_n", "_span", "_fmin", "_df", (F.col("_w0") / F.col("_sw")).alias("_w"),
        (F.col("val") - F.col("_ym")).alias("_y"), (F.col("mjd") - F.col("_tm")).alias("_t2"), (F.col("mjd") - F.col("_t0")).alias("_t"),
    ))
    found = join_small(points, best_bins(points), ["_series"])
    found = found.withColumn("_f", F.col("_fmin") + F.col("_df") * F.col("_i"))
    arg = F.lit(2.0 * math.pi) * F.col("_f") * F.col("_t")
    found = found.select("_series", "_i", "_f", "_steps", "_n", "_span", "_w", "_y", "_t2", F.cos(arg).alias("_c"), F.sin(arg).alias("_s"))
    term = lambda e: F.expr(f"sum(_w * {e})")
    sums = found.groupBy("_series", "_i", "_f", "_steps", "_n", "_span").agg(
        term("_c").alias("c"), term("_s").alias("s"), term("_y * _c").alias("yc"), term("_y * _s").alias("ys"),
        term("_c * _c").alias("cc0"), term("_c * _s").alias("cs0"), term("_y * _y").alias("yy"),
        term("_t2 * _t2").alias("tt"), term("_t2").alias("t1"),
    )
    sums = sums.selectExpr(
        "_series", "_i", "_f", "_steps", "_n", "_span", "yy", "tt - t1 * t1 AS vt", "yc", "ys",
        "cc0 - c * c AS cc", "1 - cc0 - s * s AS ss", "cs0 - c * s AS cs",
    )
    power = "try_divide(ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys, yy * (cc * ss - cs * cs))"
    sums = sums.selectExpr("*", f"{power} AS power")
    best = sums.groupBy("_series").agg(
        F.max_by(F.struct("_i", "_f", "_steps", "_n", "_span", "vt", "power"), F.struct("power", -F.col("_i"))).alias("b")
    ).select("_series", "b.*").join(const.select(*keys, "_series"), "_series")
    frac = F.when(F.col("_steps") > 0, F.col("_i") / F.col("_steps")).otherwise(0.5)
    inside = (frac > cfg.edge_guard_frac) & (frac < 1 - cfg.edge_guard_frac)
    return best.select(
        *keys,
        F.when(inside, 1.0 / F.col("_f")).alias("best_period"),
        "power",
        F.when(inside, baluev_fap(F.col("power"), F.col("_n"), F.col("_span"), F.col("vt"))).alias("fap"),
    )


def best_bins(points: DataFrame) -> DataFrame:
    """_series, _i: the frequencies of each series whose exact power can be the highest."""
    from pyspark.sql.types import LongType, StructField, StructType

    rows = points.select("_series", "_steps", "_fmin", "_df", "_w", "_y", "_t")
    cells = rows.mapInPandas(_spread_points, "_series long, _steps int, _twice int, _cell int, wr double, wi double, yr double, yi double, yy double")
    sums = cells.groupBy("_series", "_steps", "_twice", "_cell").agg(*[F.sum(c).alias(c) for c in ("wr", "wi", "yr", "yi", "yy")])
    out = StructType([StructField("_series", LongType()), StructField("_i", LongType())])
    return cut_lineage(sums.groupBy("_series").applyInPandas(_peaks, out))


def _grid_size(steps):
    """Cells of the grid of ``steps + 1`` frequencies: a power of two, at least twice as many."""
    return 2 ** np.ceil(np.log2(np.maximum(2 * (steps + 1), 4 * SPREAD))).astype(np.int64)


def _width(size):
    """Variance parameter of the Gaussian on a grid of ``size`` cells for half as many modes."""
    return math.pi * SPREAD / (3.0 * (size / 2.0) ** 2)


def _spread_points(frames):
    """Complex sums of w and w y on grid cells, at the frequencies and (w alone) at twice them."""
    import pandas as pd

    for df in frames:
        steps, w, y, t = (df[c].to_numpy() for c in ("_steps", "_w", "_y", "_t"))
        size = _grid_size(steps)
        parts = []
        for twice in (0, 1):
            x = 2 * np.pi * df["_df"].to_numpy() * t * (1 + twice)
            turned = np.exp(1j * (2 * np.pi * df["_fmin"].to_numpy() * t * (1 + twice) + size / 4 * x))
            step = 2 * np.pi / size
            cell = np.floor(x / step)[:, None] + np.arange(1 - SPREAD, SPREAD + 1)
            bell = np.exp(-((cell * step[:, None] - x[:, None]) ** 2) / (4 * _width(size))[:, None])
            c = (w * turned)[:, None] * bell
            part = pd.DataFrame({
                "_series": np.repeat(df["_series"].to_numpy(), 2 * SPREAD), "_steps": np.repeat(steps, 2 * SPREAD).astype(np.int32),
                "_twice": np.int32(twice), "_cell": (cell.astype(np.int64) % size[:, None]).ravel().astype(np.int32),
                "wr": c.real.ravel(), "wi": c.imag.ravel()})
            cy = c * y[:, None] if not twice else np.zeros((0, 0))
            part["yr"], part["yi"] = (cy.real.ravel(), cy.imag.ravel()) if not twice else (0.0, 0.0)
            part["yy"] = np.where(np.tile(np.arange(2 * SPREAD) == 0, len(df)) & (twice == 0), np.repeat(w * y * y, 2 * SPREAD), 0.0)
            parts.append(part)
        every = pd.concat(parts)
        yield every.groupby(["_series", "_steps", "_twice", "_cell"], as_index=False).sum()


def _peaks(df):
    """Frequencies of one series that can be the best, from the sums on its cells."""
    import pandas as pd

    steps = int(df["_steps"].iloc[0])
    size = int(_grid_size(np.array([steps]))[0])
    modes = np.arange(steps + 1) - size // 4
    undo = math.sqrt(math.pi / _width(size)) * np.exp(modes**2 * _width(size))

    def transform(part, re, im):
        cells = np.zeros(size, complex)
        cells[part["_cell"].to_numpy()] = part[re].to_numpy() + 1j * part[im].to_numpy()
        return np.fft.ifft(cells)[modes % size] * undo

    once, twice = df[df["_twice"] == 0], df[df["_twice"] == 1]
    f, fy, f2 = transform(once, "wr", "wi"), transform(once, "yr", "yi"), transform(twice, "wr", "wi")
    c, s, yc, ys, yy = f.real, f.imag, fy.real, fy.imag, df["yy"].sum()
    cc0, cs0 = (1 + f2.real) / 2, f2.imag / 2
    cc, ss, cs = cc0 - c * c, 1 - cc0 - s * s, cs0 - c * s
    with np.errstate(all="ignore"):
        power = (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (yy * (cc * ss - cs * cs))
    loose = ~np.isfinite(power) | (np.abs(cc * ss - cs * cs) < 1e-7)  # too close to singular for gridded sums
    top = power[~loose].max() if (~loose).any() else -np.inf
    return pd.DataFrame({"_series": df["_series"].iloc[0], "_i": np.flatnonzero(loose | (power >= top - CLOSE))})


def baluev_fap(z, n, span, var_t, nyquist_factor: float = 5.0, samples_per_peak: float = 5.0):
    """False-alarm bound of a standard-normalised peak (Baluev 2008), 2 free parameters.

    The bandwidth is the full default one, ``nyquist_factor * n / (2 * span)``, not the
    searched range. ``var_t`` is the weighted variance of the times.
    """
    nh, nk = n - 1, n - 3
    # upper end of the default grid: half a step plus a whole number of steps
    f_max = (F.bround(samples_per_peak * nyquist_factor * 0.5 * n - 0.5) + 0.5) / (samples_per_peak * span)
    tau_w = f_max * F.sqrt(4.0 * math.pi * var_t)
    gamma = F.when(n > 3, F.sqrt(F.lit(2.0) / nh) * F.exp(_lgamma(nh / 2.0) - _lgamma((n - 2) / 2.0)))
    fap_s = F.pow(1.0 - z, nk / 2.0)
    tau = gamma * tau_w * F.pow(1.0 - z, 0.5 * (n - 4)) * F.sqrt(0.5 * nh * z)
    return fap_s + (1.0 - fap_s) * (1.0 - F.exp(-tau))


def _lgamma(x):
    """Stirling series for ln Gamma, shifted by eight for accuracy at small arguments."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2.0 * math.pi) + 1.0 / (12.0 * y) - 1.0 / (
        360.0 * F.pow(y, 3.0)
    ) + 1.0 / (1260.0 * F.pow(y, 5.0))
    shift = F.lit(0.0)
    for k in range(8):
        shift = shift + F.log(x + float(k))
    return series - shift


def candidate_periodic(
    spacings: DataFrame, periods: DataFrame, keys: Sequence[str], cfg: PeriodConfig = PeriodConfig()
) -> DataFrame:
    """Regular spacing, or a significant period that fits the median gap."""
    df = spacings.join(periods, list(keys), "left")
    regular = F.coalesce(F.col("spacing_cv") < cfg.cv_threshold, F.lit(False))
    off = F.try_divide(F.abs(F.col("best_period") - F.col("median_gap")), F.col("median_gap"))
    fits = F.coalesce((F.col("fap") < cfg.fap_threshold) & (off < cfg.gap_match), F.lit(False))
    return df.withColumn("candidate_periodic", regular | fits)
