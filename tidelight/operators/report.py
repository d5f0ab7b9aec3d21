"""The full record of detected events: false-alarm probability and recurrence beside the event itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DetectorConfig, PeriodConfig
from ..functions.expr import rnd
from . import bootstrap, periodic

FIELDS = [
    "outburst_id", "mjd_start", "mjd_end", "duration_days", "n_points", "peak_value", "peak_mjd", "baseline_value",
    "significance_sigma", "fap_empirical", "candidate_periodic", "best_period_days", "period_fap", "spacing_cv",
]


def event_records(
    events: DataFrame, curves: DataFrame, keys: Sequence[str], cfg: DetectorConfig = DetectorConfig(), period_cfg: PeriodConfig = PeriodConfig(),
    cadences: DataFrame | None = None,
) -> DataFrame:
    """keys and ``FIELDS`` of each event, rounded as they are written.

    ``curves`` are the series the events were found in; for the false-alarm probability they need base, sigma
    and quiet. It is NULL where ``cfg.skip_fap`` is set or curves come with their ``cadences``: those
    are not bounded, and a resampled series is held by one task.
    """
    keys = list(keys)
    if cfg.skip_fap or cadences is not None:
        rows = events.withColumn("fap_empirical", F.lit(None).cast("double"))
    else:
        rows = bootstrap.false_alarm(events, curves, keys, cfg)
    gaps = periodic.spacing(events, keys, "mjd_start", period_cfg)
    repeat = curves.join(gaps.select(*keys), keys, "left_semi")
    period = periodic.candidate_periodic(gaps, periodic.periodogram(repeat, keys, period_cfg, cadences), keys, period_cfg)
    rows = rows.join(period, keys, "left")
    drop0 = lambda c: F.when(c != 0, c)
    return rows.select(
        *keys, "outburst_id", rnd(F.col("mjd_start"), 4).alias("mjd_start"), rnd(F.col("mjd_end"), 4).alias("mjd_end"),
        rnd(F.col("duration_days"), 4).alias("duration_days"), "n_points",
        rnd(F.col("peak_value"), 6).alias("peak_value"), rnd(F.col("peak_mjd"), 4).alias("peak_mjd"),
        rnd(F.col("baseline_value"), 6).alias("baseline_value"),
        rnd(F.col("significance_sigma"), 2).alias("significance_sigma"),
        rnd(F.col("fap_empirical"), 4).alias("fap_empirical"),
        F.coalesce("candidate_periodic", F.lit(False)).alias("candidate_periodic"),
        drop0(rnd(F.col("best_period"), 3)).alias("best_period_days"),
        F.when(F.col("fap") != 0, F.format_string("%.2e", "fap")).alias("period_fap"),
        drop0(rnd(F.col("spacing_cv"), 3)).alias("spacing_cv"),
    )
