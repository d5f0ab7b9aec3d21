"""Weighted rebinning of raw light curves.

Raw series are unbounded; rebinned ones are not. A series that is binned daily has
at most one row per day, and one that is not has a median spacing of at least half a
day, so at least half of its gaps are that long and it has at most ``4 * span + 1``
rows. Hence every later window over a rebinned series is bounded by the time span it
covers, whatever the size of the input.

The raw rows themselves are only touched by map-side combined aggregates: they are
never sorted or windowed per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import RebinConfig
from ..functions.expr import inv_var
from ..session import cut_lineage
from .skew import join_small


def _weighted():
    return [
        (F.col("_swv") / F.col("_sw")).alias("val"),
        F.sqrt(1.0 / F.col("_sw")).alias("err"),
    ]


def _sums(cfg: RebinConfig):
    w = inv_var(F.col("err"), cfg.min_err)
    return [
        F.sum(w).alias("_sw"),
        F.sum(w * F.col("val")).alias("_swv"),
        F.count("*").alias("_n"),
    ]


def rebin_daily(lc: DataFrame, keys: Sequence[str], cfg: RebinConfig = RebinConfig()) -> DataFrame:
    """Inverse-variance mean per day, stamped at mid-day."""
    binned = lc.groupBy(*keys, (F.floor("mjd") + 0.5).alias("mjd")).agg(*_sums(cfg))
    return binned.select(*keys, "mjd", *_weighted(), F.col("_n").alias("n_raw"))


def dedupe_exact(lc: DataFrame, keys: Sequence[str], cfg: RebinConfig = RebinConfig()) -> DataFrame:
    """Inverse-variance merge of rows that share a timestamp."""
    merged = lc.groupBy(*keys, "mjd").agg(*_sums(cfg))
    return merged.select(*keys, "mjd", *_weighted(), F.col("_n").alias("n_raw"))


def _half_day_cells(lc: DataFrame, keys: Sequence[str], cfg: RebinConfig) -> DataFrame:
    """Per half-open cell of the cadence threshold: sums, count and time extent.

    Two rows of one cell are closer than the threshold, so only the gaps between
    cells have to be looked at to know on which side of it the median gap lies.
    """
    cell = F.floor(F.col("mjd") / cfg.cadence_threshold_days)
    cells = lc.groupBy(*keys, cell.alias("_cell")).agg(
        *_sums(cfg), F.min("mjd").alias("_first"), F.max("mjd").alias("_last")
    )
    ordered = Window.partitionBy(*keys).orderBy("_cell")
    whole = Window.partitionBy(*keys)
    gap = F.col("_first") - F.lag("_last").over(ordered)
    cells = cells.withColumn("_gap", gap)
    short = F.col("_n") - 1 + F.when(F.col("_gap") < cfg.cadence_threshold_days, 1).otherwise(0)
    cells = cells.withColumn("_m", F.sum("_n").over(whole) - 1).withColumn(
        "_short", F.sum(short).over(whole)
    )
    twice = F.col("_short") * 2
    # NULL: an even number of gaps splits exactly in half, the two middle ones decide
    return cells.withColumn(
        "_daily",
        F.when(F.col("_m") == 0, F.lit(False))
        .when(twice > F.col("_m"), F.lit(True))
        .when(twice < F.col("_m"), F.lit(False)),
    )


def rebin_series(
    lc: DataFrame, keys: Sequence[str], cfg: RebinConfig = RebinConfig()
) -> DataFrame:
    """Daily bins where the median spacing is below the threshold, else exact merge."""
    # at most two rows per day and series; read by both branches
    cells = cut_lineage(_half_day_cells(lc, keys, cfg))
    per_day = round(1.0 / cfg.cadence_threshold_days)
    day = F.floor(F.col("_cell") / per_day) + 0.5
    daily = (
        cells.where("_daily")
        .groupBy(*keys, day.alias("mjd"))
        .agg(F.sum("_sw").alias("_sw"), F.sum("_swv").alias("_swv"), F.sum("_n").alias("_n"))
        .select(*keys, "mjd", *_weighted(), F.col("_n").alias("n_raw"))
    )
    sparse = (
        cells.where(F.col("_daily").isNull() | ~F.col("_daily"))
        .groupBy(*keys)
        .agg(F.max("_daily").alias("_daily"))
    )
    sparse = cut_lineage(sparse)
    if sparse.isEmpty():
        return daily
    times = join_small(lc.select(*keys, "mjd", "val", "err"), sparse, keys)
    times = times.groupBy(*keys, "mjd").agg(*_sums(cfg), F.max("_daily").alias("_daily"))
    gap = F.col("mjd") - F.lag("mjd").over(Window.partitionBy(*keys).orderBy("mjd"))
    whole = Window.partitionBy(*keys)
    t = cfg.cadence_threshold_days
    times = times.withColumn("_gap", gap)
    lower = F.coalesce(F.max(F.when(F.col("_gap") < t, F.col("_gap"))).over(whole), F.lit(0.0))
    upper = F.min(F.when(F.col("_gap") >= t, F.col("_gap"))).over(whole)
    times = times.withColumn("_daily", F.coalesce("_daily", (lower + upper) / 2 < t))
    bin_ = F.when(F.col("_daily"), F.floor("mjd") + 0.5).otherwise(F.col("mjd"))
    exact = (
        times.groupBy(*keys, bin_.alias("mjd"))
        .agg(F.sum("_sw").alias("_sw"), F.sum("_swv").alias("_swv"), F.sum("_n").alias("_n"))
        .select(*keys, "mjd", *_weighted(), F.col("_n").alias("n_raw"))
    )
    return daily.unionByName(exact)
