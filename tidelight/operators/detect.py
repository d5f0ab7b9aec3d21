"""Hysteresis event detection on rebinned series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import BaselineConfig, DetectorConfig
from ..functions.expr import inv_var, safe_div
from .baseline import baseline_global, baseline_rolling


def cadence(series: DataFrame, keys: Sequence[str], default: float | None = 1.0) -> DataFrame:
    """Adds ``cadence``, the median spacing of the (bounded) series."""
    ordered = Window.partitionBy(*keys).orderBy("mjd")
    df = series.withColumn("_gap", F.col("mjd") - F.lag("mjd").over(ordered))
    med = F.median("_gap").over(Window.partitionBy(*keys))
    return df.withColumn("cadence", F.coalesce(med, F.lit(default))).drop("_gap")


def islands(rows: DataFrame, keys: Sequence[str], max_gap) -> DataFrame:
    """Adds ``run``: rows of a key stay together unless the time gap exceeds ``max_gap``."""
    ordered = Window.partitionBy(*keys).orderBy("mjd")
    cut = F.col("mjd") - F.lag("mjd").over(ordered) > max_gap
    df = rows.withColumn("_cut", F.when(cut, 1).otherwise(0))
    return df.withColumn("run", F.sum("_cut").over(ordered)).drop("_cut")


def true_runs(rows: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Maximal stretches of consecutive rows with ``flag`` set: first and last time, length."""
    ordered = Window.partitionBy(*keys).orderBy("mjd")
    df = rows.withColumn("_i", F.row_number().over(ordered)).where(F.col(flag))
    df = df.withColumn("_g", F.col("_i") - F.row_number().over(ordered))
    return df.groupBy(*keys, "_g").agg(
        F.min("mjd").alias("t_start"), F.max("mjd").alias("t_end"), F.count("*").alias("n_points")
    ).drop("_g")


def merge_runs(runs: DataFrame, keys: Sequence[str], min_separation: float) -> DataFrame:
    """Join runs of a key whose separation is below ``min_separation``."""
    ordered = Window.partitionBy(*keys).orderBy("t_start")
    far = F.col("t_start") - F.lag("t_end").over(ordered) >= min_separation
    df = runs.withColumn("_g", F.sum(F.when(far, 1).otherwise(0)).over(ordered))
    return df.groupBy(*keys, "_g").agg(
        F.min("t_start").alias("t_start"),
        F.max("t_end").alias("t_end"),
        F.sum("n_points").alias("n_points"),
    ).drop("_g")


def with_thresholds(
    df: DataFrame, keys: Sequence[str], cfg: DetectorConfig = DetectorConfig()
) -> DataFrame:
    """Adds ``z``, ``seed``, ``weak`` and the per-series ``max_gap``, ``min_dur``."""
    df = cadence(df, keys)
    excess = F.col("val") - F.col("base")
    df = df.withColumn("z", safe_div(excess, F.col("sigma")))
    tall = F.when(F.col("base") > 0, F.col("val") > cfg.min_ratio * F.col("base")).otherwise(
        excess > cfg.min_ratio * F.col("sigma")
    )
    whole = Window.partitionBy(*keys)
    usable = F.min("sigma").over(whole) > 0
    return (
        df.withColumn("seed", usable & tall & (F.col("z") > cfg.nsigma_enter))
        .withColumn("weak", usable & tall & (F.col("z") > cfg.nsigma_exit))
        .withColumn(
            "max_gap",
            F.greatest(cfg.max_gap_factor * F.col("cadence"), F.lit(2.0 * cfg.min_separation_days)),
        )
        .withColumn(
            "min_dur",
            F.greatest(F.lit(cfg.min_duration_days), cfg.cadence_duration_factor * F.col("cadence")),
        )
    )


def long_enough(series: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Only series with at least ``n`` rows."""
    size = F.count("*").over(Window.partitionBy(*keys))
    return series.withColumn("_size", size).where(F.col("_size") >= n).drop("_size")


def hysteresis_runs(
    based: DataFrame, keys: Sequence[str], cfg: DetectorConfig = DetectorConfig()
) -> DataFrame:
    """Rows of the islands of weak points that hold enough seeds."""
    df = with_thresholds(based, keys, cfg)
    df = islands(df.where("weak"), keys, F.col("max_gap"))
    per_run = Window.partitionBy(*keys, "run")
    seeds = F.sum(F.col("seed").cast("long")).over(per_run)
    return df.withColumn("n_seed", seeds).where(F.col("n_seed") >= cfg.min_seed_points)


def detect_events(
    based: DataFrame, keys: Sequence[str], cfg: DetectorConfig = DetectorConfig()
) -> DataFrame:
    """One row per event of series that already carry ``base`` and ``sigma``.

    Islands are further apart than any merge distance and all their rows exceed the
    exit level, so the gates on size, duration, pooled significance and seeds are the
    only ones that can reject.
    """
    df = islands(with_thresholds(based, keys, cfg).where("weak"), keys, F.col("max_gap"))
    w = inv_var(F.col("err"))
    runs = df.groupBy(*keys, "run").agg(
        F.min("mjd").alias("mjd_start"),
        F.max("mjd").alias("mjd_end"),
        F.count("*").alias("n_points"),
        F.sum(F.col("seed").cast("long")).alias("n_seed"),
        F.max("val").alias("peak_value"),
        F.max_by("mjd", F.struct(F.col("val"), -F.col("mjd"))).alias("peak_mjd"),
        F.avg("base").alias("baseline_value"),
        F.median("sigma").alias("_sig"),
        F.sum(w).alias("_sw"),
        F.sum(w * F.col("val")).alias("_swv"),
        F.max("z").alias("significance_sigma"),
        F.avg("z").alias("mean_significance_sigma"),
        F.max("min_dur").alias("_min_dur"),
    )
    pooled = F.hypot(F.sqrt(1.0 / F.col("_sw")), F.col("_sig"))
    runs = runs.withColumn("duration_days", F.col("mjd_end") - F.col("mjd_start")).withColumn(
        "block_z", (F.col("_swv") / F.col("_sw") - F.col("baseline_value")) / pooled
    )
    runs = runs.where(
        (F.col("n_seed") >= cfg.min_seed_points)
        & (F.col("n_points") >= cfg.min_points)
        & (F.col("duration_days") >= F.col("_min_dur"))
        & (F.col("block_z") > cfg.nsigma_exit)
    )
    ordinal = F.row_number().over(Window.partitionBy(*keys).orderBy("mjd_start"))
    return runs.select(
        *keys,
        ordinal.cast("long").alias("outburst_id"),
        "mjd_start",
        "mjd_end",
        "duration_days",
        "n_points",
        "peak_value",
        "peak_mjd",
        "baseline_value",
        "significance_sigma",
        "mean_significance_sigma",
        "block_z",
    )


def with_baseline(
    series: DataFrame,
    keys: Sequence[str],
    cfg: DetectorConfig = DetectorConfig(),
    base_cfg: BaselineConfig = BaselineConfig(),
) -> DataFrame:
    """Size gate, then global or rolling baseline as configured."""
    series = long_enough(series, keys, cfg.min_series_points)
    if cfg.rolling_baseline_days:
        return baseline_rolling(series, keys, cfg.rolling_baseline_days, base_cfg)
    return baseline_global(series, keys, base_cfg)
