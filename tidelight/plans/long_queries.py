"""Curves that are merged exactly but never binned: events, hysteresis points, fluence times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DetectorConfig
from ..functions.expr import rnd
from ..operators import rebin, segments
from ..sources import readers
from ..sources.tables import lightcurve, optical
from . import sqltext as q
from .series_queries import EV_COLS, MERGED
from .sqltext import LC, OPT, with_

#: The optical bands of the test tables vary by a factor of two around a broad level: low gates, short gaps.
SENSITIVE = DetectorConfig(
    nsigma_enter=1.0, nsigma_exit=0.3, min_ratio=1.02, min_separation_days=0.01, min_duration_days=0.005, cadence_duration_factor=0.5)


def _rounded(df, *keys):
    return df.select(
        *keys, "outburst_id", *[rnd(F.col(c), 4).alias(c) for c in ("mjd_start", "mjd_end", "duration_days")], "n_points",
        rnd(F.col("peak_value"), 6).alias("peak_value"), rnd(F.col("peak_mjd"), 4).alias("peak_mjd"),
        rnd(F.col("baseline_value"), 6).alias("baseline_value"), rnd(F.col("significance_sigma"), 2).alias("significance_sigma"),
        rnd(F.col("mean_significance_sigma"), 4).alias("mean_significance_sigma"), rnd(F.col("block_z"), 4).alias("block_z"))


def merged(spark, sf):
    return rebin.dedupe_exact(lightcurve(spark, sf), ["source"])


def raw_event_table(spark, sf):
    """Events of every source on its exactly merged curve."""
    return _rounded(segments.detect_long_events(merged(spark, sf), ["source"]), "source")


def optical_curves(spark, sf):
    """One long curve for each filter, in millionths of the flux of magnitude 0."""
    opt = optical(spark, sf).withColumnRenamed("filtercode", "band")
    df = readers.clean_optical(opt.select("band", "mjd", "mag", "magerr", "catflags"), ["band"])
    return df.select("band", "mjd", (F.col("val") * 1e6).alias("val"), (F.col("err") * 1e6).alias("err"))


def optical_event_table(spark, sf):
    """Events of the optical bands, each band one curve that is never binned."""
    return _rounded(segments.detect_long_events(optical_curves(spark, sf), ["band"], SENSITIVE), "band")


def optical_weak_points(spark, sf):
    """Points of the bands above the exit level, with their run and its seeds."""
    df = segments.long_runs(segments.weak_points(optical_curves(spark, sf), ["band"], SENSITIVE), ["band"])
    return df.select("band", rnd(F.col("mjd"), 5).alias("mjd"), rnd(F.col("z"), 4).alias("z"), "seed", F.col("run").cast("long").alias("run"), "n_seed")


def raw_fluence_times(spark, sf):
    """5, 95 and 90 percent fluence times of each exactly merged curve."""
    g = segments.fluence_times(merged(spark, sf), ["source"], {"t5": 0.05, "t95": 0.95})
    return g.select("source", *[rnd(F.col(c), 4).alias(c) for c in ("t5", "t95")], rnd(F.col("t95") - F.col("t5"), 4).alias("t90"))


QUERIES = {f.__name__: f for f in (raw_event_table, optical_event_table, optical_weak_points, raw_fluence_times)}

RAW = f"x AS (SELECT source, mjd, {MERGED} FROM lc GROUP BY source, mjd)"
BANDS = """
o0 AS (SELECT filtercode AS band, mjd, pow(10.0, -0.4 * mag) AS v, pow(10.0, -0.4 * mag) * (ln(10.0) * 0.4) * magerr AS e,
         count(*) OVER (PARTITION BY filtercode) AS c FROM opt WHERE catflags = 0 AND magerr > 0),
o AS (SELECT band, mjd, 1e6 * sum(v / greatest(e, 1e-8) ** 2) / sum(1.0 / greatest(e, 1e-8) ** 2) AS val,
        1e6 * sqrt(1.0 / sum(1.0 / greatest(e, 1e-8) ** 2)) AS err FROM o0 WHERE c >= 10 GROUP BY 1, 2)"""
_FOUND = q.events_of("e", "b", "band", enter=1.0, exit_=0.3, ratio=1.02, gap=0.02, dur=0.005, factor=0.5)

ORACLE = {
    "raw_event_table": with_(LC, RAW, q.gated("xg", "x", "source"), q.based("b", "xg", "source"), q.events_of("e", "b", "source"))
    + f"SELECT {EV_COLS} FROM e",
    "optical_event_table": with_(OPT, BANDS, q.gated("og", "o", "band"), q.based("b", "og", "band"), _FOUND)
    + f"SELECT {EV_COLS.replace('source', 'band', 1)} FROM e",
    "optical_weak_points": with_(OPT, BANDS, q.gated("og", "o", "band"), q.based("b", "og", "band"), _FOUND) + """
SELECT band, round(mjd, 5) + 0.0 AS mjd, round(z, 4) + 0.0 AS z, seed, CAST(run AS BIGINT) AS run,
       CAST(sum(seed::INT) OVER (PARTITION BY band, run) AS BIGINT) AS n_seed FROM e_r""",
    "raw_fluence_times": with_(
        LC, RAW,
        "c0 AS (SELECT source, mjd, greatest(val, 0.0) AS f, lag(mjd) OVER g AS pt, lag(greatest(val, 0.0)) OVER g AS pf FROM x WINDOW g AS (PARTITION BY source ORDER BY mjd))",
        "c1 AS (SELECT *, coalesce(0.5 * (f + pf) * (mjd - pt), 0.0) AS a FROM c0)",
        "c2 AS (SELECT *, sum(a) OVER (PARTITION BY source ORDER BY mjd) AS cum, sum(a) OVER (PARTITION BY source) AS tot FROM c1)",
        "c3 AS (SELECT *, cum / tot AS q1, (cum - a) / tot AS q0 FROM c2 WHERE tot > 0)",
        """c4 AS (SELECT source, min(pt + (0.05 - q0) / (q1 - q0) * (mjd - pt)) FILTER (WHERE q0 < 0.05 AND q1 >= 0.05) AS t5,
             min(pt + (0.95 - q0) / (q1 - q0) * (mjd - pt)) FILTER (WHERE q0 < 0.95 AND q1 >= 0.95) AS t95 FROM c3 GROUP BY source)""",
    ) + "SELECT source, round(t5, 4) + 0.0 AS t5, round(t95, 4) + 0.0 AS t95, round(t95 - t5, 4) + 0.0 AS t90 FROM c4",
}
