"""Light-curve queries: rebinning, baselines, islands, events, periodicity."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import BaselineConfig, DetectorConfig
from ..functions.expr import rnd
from ..operators import baseline, detect, rebin
from ..sources.tables import lightcurve
from . import sqltext as q
from .sqltext import LC, r, with_

SRC = ["source"]


def series(spark, sf):
    return rebin.rebin_series(lightcurve(spark, sf), SRC)


def based_series(spark, sf, cfg=DetectorConfig()):
    return detect.with_baseline(series(spark, sf), SRC, cfg)


def events(spark, sf, cfg=DetectorConfig()):
    return detect.detect_events(based_series(spark, sf, cfg), SRC, cfg)


def _points(df, *extra):
    return df.select(
        "source", rnd(F.col("mjd"), 4).alias("mjd"), rnd(F.col("val"), 6).alias("val"),
        rnd(F.col("err"), 6).alias("err"), *extra,
    )


def rebin_daily(spark, sf):
    df = rebin.rebin_daily(lightcurve(spark, sf), ["source", "band"])
    return _points(df, "band", "n_raw")


def dedupe_exact(spark, sf):
    lc = lightcurve(spark, sf).withColumn("mjd", F.floor(F.col("mjd") * 4) / 4)
    return _points(rebin.dedupe_exact(lc, SRC), "n_raw")


def rebin_switch(spark, sf):
    """Per (source, band): sparse series merge exactly, dense ones go daily."""
    lc = lightcurve(spark, sf)
    both = lc.select("source", "mjd", "val", "err", F.lit("all").alias("band")).unionByName(
        lc.select("source", "mjd", "val", "err", "band")
    )
    return _points(rebin.rebin_series(both, ["source", "band"]), "band", "n_raw")


def cadence_median(spark, sf):
    df = detect.cadence(series(spark, sf), SRC)
    return df.groupBy("source").agg(
        F.count("*").alias("n_points"), rnd(F.max("cadence"), 6).alias("cadence")
    )


def sigma_clip_baseline(spark, sf):
    df = baseline.baseline_global(series(spark, sf), SRC)
    return df.groupBy("source").agg(
        rnd(F.max("base"), 6).alias("base"),
        rnd(F.max("sigma"), 6).alias("sigma"),
        F.sum(F.col("quiet").cast("long")).alias("n_quiet"),
        F.count("*").alias("n_points"),
    )


def rolling_baseline(spark, sf):
    df = baseline.baseline_rolling(series(spark, sf), SRC, 21.0, BaselineConfig())
    return df.select(
        "source", rnd(F.col("mjd"), 4).alias("mjd"), rnd(F.col("base"), 6).alias("base"),
        rnd(F.col("sigma"), 6).alias("sigma"), "quiet",
    )


def mad_scatter(spark, sf):
    """Median, scaled MAD and the fallback chain MAD, deviation, 1e-6; plus the 3-sigma line."""
    whole = Window.partitionBy("source")
    df = series(spark, sf).withColumn("med", F.median("val").over(whole))
    df = df.withColumn("dev", F.abs(F.col("val") - F.col("med")))
    stats = df.groupBy("source").agg(
        F.max("med").alias("baseline"),
        (F.median("dev") * 1.4826).alias("mad"),
        F.stddev_pop("val").alias("sd"),
    )
    spread = F.when(F.col("mad") > 0, F.col("mad")).when(F.col("sd") > 0, F.col("sd")).otherwise(1e-6)
    return stats.select(
        "source", rnd(F.col("baseline"), 6).alias("baseline"), rnd(spread, 6).alias("scatter"),
        rnd(F.col("baseline") + 3.0 * spread, 6).alias("threshold"),
    )


def weighted_mean(spark, sf):
    df = series(spark, sf)
    w = 1.0 / F.pow(F.greatest(F.col("err"), F.lit(1e-8)), F.lit(2.0))
    g = df.groupBy("source").agg(
        F.sum(w).alias("sw"), F.sum(w * F.col("val")).alias("swv"), F.avg("val").alias("m"),
        F.stddev_samp("val").alias("sd"),
    )
    ok = F.col("sw") > 0
    return g.select(
        "source",
        rnd(F.when(ok, F.col("swv") / F.col("sw")).otherwise(F.col("m")), 6).alias("mean"),
        rnd(F.when(ok, F.sqrt(1.0 / F.col("sw"))).otherwise(F.coalesce("sd", F.lit(0.0))), 6).alias("mean_err"),
    )


def islands(spark, sf):
    df = detect.with_thresholds(based_series(spark, sf), SRC)
    df = detect.islands(df.where("weak"), SRC, F.col("max_gap"))
    return df.groupBy("source", "run").agg(
        rnd(F.min("mjd"), 4).alias("t_start"), rnd(F.max("mjd"), 4).alias("t_end"),
        F.count("*").alias("n_points"), F.sum(F.col("seed").cast("long")).alias("n_seed"),
    )


def hysteresis_points(spark, sf):
    df = detect.hysteresis_runs(based_series(spark, sf), SRC)
    return df.select(
        "source", rnd(F.col("mjd"), 4).alias("mjd"), rnd(F.col("val"), 6).alias("val"),
        rnd(F.col("z"), 4).alias("z"), "seed", "run", "n_seed",
    )


def _rounded_events(df):
    return df.select(
        "source", "outburst_id",
        rnd(F.col("mjd_start"), 4).alias("mjd_start"), rnd(F.col("mjd_end"), 4).alias("mjd_end"),
        rnd(F.col("duration_days"), 4).alias("duration_days"), "n_points",
        rnd(F.col("peak_value"), 6).alias("peak_value"), rnd(F.col("peak_mjd"), 4).alias("peak_mjd"),
        rnd(F.col("baseline_value"), 6).alias("baseline_value"),
        rnd(F.col("significance_sigma"), 2).alias("significance_sigma"),
        rnd(F.col("mean_significance_sigma"), 4).alias("mean_significance_sigma"),
        rnd(F.col("block_z"), 4).alias("block_z"),
    )


def event_table(spark, sf):
    return _rounded_events(events(spark, sf))


def event_table_rolling(spark, sf):
    return _rounded_events(events(spark, sf, DetectorConfig(rolling_baseline_days=21.0)))


def true_runs(spark, sf):
    """Stretches of consecutive points above the median, merged below 3 days."""
    df = baseline.baseline_global(series(spark, sf), SRC)
    df = df.withColumn("high", F.col("val") > F.col("base"))
    runs = detect.merge_runs(detect.true_runs(df, SRC, "high"), SRC, 3.0)
    return runs.select(
        "source", rnd(F.col("t_start"), 4).alias("t_start"), rnd(F.col("t_end"), 4).alias("t_end"), "n_points"
    )


QUERIES = {
    "rebin_daily": rebin_daily,
    "dedupe_exact": dedupe_exact,
    "rebin_switch": rebin_switch,
    "cadence_median": cadence_median,
    "sigma_clip_baseline": sigma_clip_baseline,
    "rolling_baseline": rolling_baseline,
    "mad_scatter": mad_scatter,
    "weighted_mean": weighted_mean,
    "islands": islands,
    "hysteresis_points": hysteresis_points,
    "event_table": event_table,
    "event_table_rolling": event_table_rolling,
    "true_runs": true_runs,
}

PTS = "source, round(mjd, 4) + 0.0 AS mjd, round(val, 6) + 0.0 AS val, round(err, 6) + 0.0 AS err"
S = q.rebinned("s", "lc", "source")
SG = q.gated("sg", "s", "source")
EV_COLS = ", ".join(
    ["source", "outburst_id", r("mjd_start", 4, "mjd_start"), r("mjd_end", 4, "mjd_end"),
     r("duration_days", 4, "duration_days"), "n_points", r("peak_value", 6, "peak_value"),
     r("peak_mjd", 4, "peak_mjd"), r("baseline_value", 6, "baseline_value"),
     r("significance_sigma", 2, "significance_sigma"),
     r("mean_significance_sigma", 4, "mean_significance_sigma"), r("block_z", 4, "block_z")]
)
W = "1.0 / greatest(err, 1e-8) ** 2"
MERGED = """
  sum({w} * val) / sum({w}) AS val, sqrt(1.0 / sum({w})) AS err, count(*) AS n_raw""".format(w=f"({W})")
# closed window of 21 days over quiet points, at least 15 of them, else the global values
ROLL = """
near AS (
  SELECT a.source, a.mjd, a.val, a.err, a.quiet, a.base AS gbase, a.sigma AS gsigma,
         b.val AS bval, b.err AS berr
  FROM b a LEFT JOIN b ON b.source = a.source AND b.quiet AND b.mjd BETWEEN a.mjd - 10.5 AND a.mjd + 10.5),
med AS (SELECT *, median(bval) OVER (PARTITION BY source, mjd) AS m,
               count(bval) OVER (PARTITION BY source, mjd) AS c FROM near),
loc AS (
  SELECT source, mjd, any_value(val) AS val, any_value(err) AS err, any_value(quiet) AS quiet,
         CASE WHEN any_value(c) >= 15 THEN any_value(m) ELSE any_value(gbase) END AS base,
         CASE WHEN any_value(c) >= 15 THEN greatest(1.4826 * median(abs(bval - m)), median(berr))
              ELSE any_value(gsigma) END AS sigma
  FROM med GROUP BY source, mjd)"""

ORACLE = {
    "rebin_daily": with_(LC) + f"""
SELECT {PTS}, band, n_raw FROM (
  SELECT source, band, floor(mjd) + 0.5 AS mjd, {MERGED} FROM lc GROUP BY source, band, floor(mjd))""",
    "dedupe_exact": with_(LC) + f"""
SELECT {PTS}, n_raw FROM (
  SELECT source, floor(mjd * 4) / 4 AS mjd, {MERGED} FROM lc GROUP BY source, floor(mjd * 4))""",
    "rebin_switch": with_(
        LC,
        "lb AS (SELECT source, band, mjd, val, err FROM lc UNION ALL SELECT source, 'all', mjd, val, err FROM lc)",
        q.rebinned("s", "lb", "source, band"),
    ) + f"SELECT {PTS}, band, n_raw FROM s",
    "cadence_median": with_(LC, S) + """
SELECT source, count(*) AS n_points, round(coalesce(median(gap), 1.0), 6) + 0.0 AS cadence FROM (
  SELECT source, mjd - lag(mjd) OVER (PARTITION BY source ORDER BY mjd) AS gap FROM s) GROUP BY source""",
    "sigma_clip_baseline": with_(LC, S, q.based("b", "s", "source")) + """
SELECT source, round(max(base), 6) + 0.0 AS base, round(max(sigma), 6) + 0.0 AS sigma,
       CAST(sum(quiet::INT) AS BIGINT) AS n_quiet, count(*) AS n_points FROM b GROUP BY source""",
    "rolling_baseline": with_(LC, S, q.based("b", "s", "source"), ROLL) + """
SELECT source, round(mjd, 4) + 0.0 AS mjd, round(base, 6) + 0.0 AS base, round(sigma, 6) + 0.0 AS sigma, quiet FROM loc""",
    "mad_scatter": with_(
        LC, S, "m AS (SELECT *, median(val) OVER (PARTITION BY source) AS med FROM s)",
        """k AS (SELECT source, max(med) AS b, median(abs(val - med)) * 1.4826 AS mad, stddev_pop(val) AS sd
               FROM m GROUP BY source)""",
        "f AS (SELECT source, b, CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE 1e-6 END AS x FROM k)",
    ) + """SELECT source, round(b, 6) + 0.0 AS baseline, round(x, 6) + 0.0 AS scatter,
       round(b + 3.0 * x, 6) + 0.0 AS threshold FROM f""",
    "weighted_mean": with_(LC, S) + f"""
SELECT source, round(sum(val * ({W})) / sum({W}), 6) + 0.0 AS mean,
       round(sqrt(1.0 / sum({W})), 6) + 0.0 AS mean_err FROM s GROUP BY source""",
    "islands": with_(LC, S, SG, q.based("b", "sg", "source"), q.events_of("e", "b", "source")) + """
SELECT source, CAST(run AS BIGINT) AS run, round(mjd_start, 4) + 0.0 AS t_start,
       round(mjd_end, 4) + 0.0 AS t_end, n_points, CAST(n_seed AS BIGINT) AS n_seed FROM e_a""",
    "hysteresis_points": with_(LC, S, SG, q.based("b", "sg", "source"), q.events_of("e", "b", "source")) + """
SELECT source, round(mjd, 4) + 0.0 AS mjd, round(val, 6) + 0.0 AS val, round(z, 4) + 0.0 AS z, seed,
       CAST(run AS BIGINT) AS run, CAST(n AS BIGINT) AS n_seed
FROM (SELECT *, sum(seed::INT) OVER (PARTITION BY source, run) AS n FROM e_r) WHERE n >= 2""",
    "event_table": with_(LC, S, SG, q.based("b", "sg", "source"), q.events_of("e", "b", "source"))
    + f"SELECT {EV_COLS} FROM e",
    "event_table_rolling": with_(
        LC, S, SG, q.based("b", "sg", "source"), ROLL, q.events_of("e", "loc", "source")
    ) + f"SELECT {EV_COLS} FROM e",
    "true_runs": with_(
        LC, S, q.based("b", "s", "source"),
        "i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY mjd) AS i FROM b)",
        "h AS (SELECT *, i - row_number() OVER (PARTITION BY source ORDER BY mjd) AS g FROM i WHERE val > base)",
        "k AS (SELECT source, min(mjd) AS t0, max(mjd) AS t1, count(*) AS n FROM h GROUP BY source, g)",
        """j AS (SELECT *, CASE WHEN t0 - lag(t1) OVER (PARTITION BY source ORDER BY t0) >= 3.0 THEN 1 ELSE 0 END AS far FROM k)""",
        "m AS (SELECT *, sum(far) OVER (PARTITION BY source ORDER BY t0) AS mg FROM j)",
    ) + """SELECT source, round(min(t0), 4) + 0.0 AS t_start, round(max(t1), 4) + 0.0 AS t_end,
       CAST(sum(n) AS BIGINT) AS n_points FROM m GROUP BY source, mg""",
}
