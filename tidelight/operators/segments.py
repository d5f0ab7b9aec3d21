"""Curves of any length, worked in segments of time.

A curve that is merged exactly but never binned has as many rows as it has times. Nothing here sorts or
windows such a curve as a whole: rows are windowed within segments of a fixed number of days,
each segment leaves a small row (its first and last time, its total, its runs), and those rows, as
many as the time span has segments, carry the state over the borders. The result does not depend on
the width of a segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import BROADCAST_BYTES, BROADCAST_ROWS, HOT_GROUP_ROWS, BaselineConfig, DetectorConfig
from ..functions.expr import inv_var, safe_div
from ..session import cut_lineage
from .skew import grouped_quantiles, join_small, split_join

#: Days of a segment.
WIDTH = 10.0


def _segment(time: str, width: float) -> Column:
    return F.floor(F.col(time) / F.lit(width))


def with_previous(rows: DataFrame, keys: Sequence[str], carry: dict[str, str], time: str = "mjd", width: float = WIDTH) -> DataFrame:
    """Adds for each ``{new: column}`` the value of the row before in time, null on the first row.

    Times are unique within a key."""
    rows = rows.withColumn("_seg", _segment(time, width))
    inside = Window.partitionBy(*keys, "_seg").orderBy(time)
    last = rows.groupBy(*keys, "_seg").agg(F.max_by(F.struct(*carry.values()), time).alias("_end"))
    between = Window.partitionBy(*keys).orderBy("_seg")  # a row for each segment
    last = last.select(*keys, "_seg", F.lag("_end").over(between).alias("_prior"))
    rows = rows.withColumn("_lag", F.lag(F.struct(*carry.values())).over(inside))
    rows = join_small(rows, last, [*keys, "_seg"])
    before = F.coalesce("_lag", "_prior")
    return rows.select("*", *[before[c].alias(new) for new, c in carry.items()]).drop("_seg", "_lag", "_prior")


def running_sum(rows: DataFrame, keys: Sequence[str], value: str, name: str, total: str, time: str = "mjd", width: float = WIDTH) -> DataFrame:
    """Adds ``name``, the sum of ``value`` up to and with each row in order of time, and ``total`` of the key."""
    rows = rows.withColumn("_seg", _segment(time, width))
    inside = Window.partitionBy(*keys, "_seg").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*keys, "_seg").agg(F.sum(value).alias("_sum"))
    between = Window.partitionBy(*keys).orderBy("_seg")
    sums = sums.select(
        *keys, "_seg", F.coalesce(F.sum("_sum").over(between.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_start"),
        F.sum("_sum").over(Window.partitionBy(*keys)).alias(total))
    rows = rows.withColumn("_part", F.sum(value).over(inside))
    rows = join_small(rows, sums, [*keys, "_seg"])
    return rows.withColumn(name, F.col("_start") + F.col("_part")).drop("_seg", "_part", "_start")


def fluence_times(curve: DataFrame, keys: Sequence[str], levels: dict[str, float], width: float = WIDTH) -> DataFrame:
    """Times at which the trapezoid sum of the positive flux reaches shares of its total, by linear interpolation."""
    rows = curve.select(*keys, "mjd", F.greatest("val", F.lit(0.0)).alias("_f"))
    rows = with_previous(rows, keys, {"_t0": "mjd", "_f0": "_f"}, width=width)
    area = 0.5 * (F.col("_f") + F.col("_f0")) * (F.col("mjd") - F.col("_t0"))
    rows = rows.withColumn("_area", F.coalesce(area, F.lit(0.0)))
    rows = running_sum(rows, keys, "_area", "_cum", "_total", width=width).where("_total > 0")
    q1, q0 = F.col("_cum") / F.col("_total"), (F.col("_cum") - F.col("_area")) / F.col("_total")

    def crossing(level: float) -> Column:
        at = F.col("_t0") + (level - q0) / (q1 - q0) * (F.col("mjd") - F.col("_t0"))
        return F.min(F.when((q0 < level) & (q1 >= level), at))

    return rows.groupBy(*keys).agg(*[crossing(level).alias(name) for name, level in levels.items()])


def median_gap(rows: DataFrame, keys: Sequence[str], width: float = WIDTH, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Per key the median spacing of its times: keys, cadence."""
    gaps = with_previous(rows.select(*keys, "mjd"), keys, {"_before": "mjd"}, width=width)
    gaps = gaps.select(*keys, (F.col("mjd") - F.col("_before")).alias("_gap"))
    return grouped_quantiles(gaps, keys, "_gap", {"cadence": 0.5}, hot_rows)


def _medians(rows: DataFrame, keys: Sequence[str], names: Sequence[str], hot: bool, hot_rows: int) -> DataFrame:
    if not hot:
        return rows.groupBy(*keys).agg(*[F.percentile(n, F.lit(0.5)).alias(n) for n in names], F.count("*").alias("_rows"))
    out = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    for n in names:
        out = out.join(grouped_quantiles(rows, keys, n, {n: 0.5}, hot_rows), list(keys))
    return out


def clipped_level(curve: DataFrame, keys: Sequence[str], cfg: BaselineConfig = BaselineConfig(), hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Per key the quiescent level of :func:`baseline.baseline_global`: keys, n, n_quiet, base, sigma.

    What a pass keeps follows from the median and scatter of the pass before, so the state is one row
    for each key; all keys go through a pass at once.
    """
    level = curve.groupBy(*keys).agg(F.count("*").alias("n")).select(
        *keys, "n", F.lit(None).cast("double").alias("_m"), F.lit(None).cast("double").alias("_s"), F.lit(False).alias("_stop"), F.lit(-1).cast("long").alias("_cnt"))
    level = cut_lineage(level)
    # a key and a few numbers: counted and measured once for all passes
    size = F.sum(F.length(F.to_json(F.struct(*keys))) + 128)
    n_keys, largest, size = level.agg(F.count("*"), F.max("n"), size).first()
    hot, few = (largest or 0) > hot_rows, n_keys <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES
    attach = lambda df, small: df.join(F.broadcast(small), list(keys)) if few else split_join(df, small, keys)
    rows = curve.select(*keys, "val", "err")
    inside = F.col("_m").isNull() | (F.abs(F.col("val") - F.col("_m")) <= cfg.clip_sigma * F.col("_s")) | (F.col("val") < F.col("_m"))
    for i in range(cfg.n_iter + 1):
        kept = attach(rows, level).where(inside)
        centre = cut_lineage(_medians(kept.select(*keys, F.col("val").alias("_med")), keys, ["_med"], hot, hot_rows))
        kept = attach(kept, centre.select(*keys, "_med"))
        spread = _medians(kept.select(*keys, F.abs(F.col("val") - F.col("_med")).alias("_dev"), F.col("err").alias("_err")), keys, ["_dev", "_err"], hot, hot_rows)
        spread = spread.select(*keys, F.greatest(cfg.mad_scale * F.col("_dev"), F.col("_err")).alias("_scat"))
        level = level.join(centre.withColumnRenamed("_rows", "_now"), list(keys)).join(spread, list(keys))
        stop = F.col("_stop") | (F.col("_now") == F.col("_cnt"))
        hold = stop | (F.col("_now") < cfg.min_points)
        if i == cfg.n_iter:
            break
        level = cut_lineage(level.select(
            *keys, "n", F.when(hold, F.col("_m")).otherwise(F.col("_med")).alias("_m"), F.when(hold, F.col("_s")).otherwise(F.col("_scat")).alias("_s"),
            hold.alias("_stop"), F.col("_now").alias("_cnt")))
    return cut_lineage(level.select(*keys, "n", F.col("_now").alias("n_quiet"), F.col("_med").alias("base"), F.col("_scat").alias("sigma")))


def weak_points(
    curve: DataFrame, keys: Sequence[str], cfg: DetectorConfig = DetectorConfig(), base_cfg: BaselineConfig = BaselineConfig(),
    width: float = WIDTH, hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Rows above the exit level of series of enough rows, with z, seed, base, sigma, max_gap, min_dur, and
    ``_seg``, ``_run``: the run of the row within its segment."""
    curve = cut_lineage(curve.select(*keys, "mjd", "val", "err"))
    level = clipped_level(curve, keys, base_cfg, hot_rows)
    cad = F.coalesce("cadence", F.lit(1.0))
    level = level.join(median_gap(curve, keys, width, hot_rows), list(keys), "left").where((F.col("n") >= cfg.min_series_points) & (F.col("sigma") > 0)).select(
        *keys, "base", "sigma", F.greatest(cfg.max_gap_factor * cad, F.lit(2.0 * cfg.min_separation_days)).alias("max_gap"),
        F.greatest(F.lit(cfg.min_duration_days), cfg.cadence_duration_factor * cad).alias("min_dur"))
    rows = join_small(curve, level, keys)
    excess = F.col("val") - F.col("base")
    rows = rows.withColumn("z", safe_div(excess, F.col("sigma")))
    tall = F.when(F.col("base") > 0, F.col("val") > cfg.min_ratio * F.col("base")).otherwise(excess > cfg.min_ratio * F.col("sigma"))
    rows = rows.where(tall & (F.col("z") > cfg.nsigma_exit)).withColumn("seed", F.col("z") > cfg.nsigma_enter)
    rows = rows.withColumn("_seg", _segment("mjd", width))
    inside = Window.partitionBy(*keys, "_seg").orderBy("mjd")
    cut = F.when(F.col("mjd") - F.lag("mjd").over(inside) > F.col("max_gap"), 1).otherwise(0)
    return rows.withColumn("_cut", cut).withColumn("_run", F.sum("_cut").over(inside)).drop("_cut")


def stitched_runs(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of a segment with the number ``run`` of the run they belong to over all segments, and their sums.

    A key has at most two open runs in each segment, and others are further apart than ``max_gap``, so the
    window below is bounded by the time span, not by rows."""
    w = inv_var(F.col("err"))
    parts = points.groupBy(*keys, "_seg", "_run", "base", "sigma", "max_gap", "min_dur").agg(
        F.min("mjd").alias("_a"), F.max("mjd").alias("_b"), F.count("*").alias("n_points"), F.sum(F.col("seed").cast("long")).alias("n_seed"),
        F.max(F.struct(F.col("val"), -F.col("mjd"))).alias("_top"), F.sum(w).alias("_sw"), F.sum(w * F.col("val")).alias("_swv"),
        F.max("z").alias("_zmax"), F.sum("z").alias("_zsum"))
    line = Window.partitionBy(*keys).orderBy("_a")
    cut = F.when(F.col("_a") - F.lag("_b").over(line) > F.col("max_gap"), 1).otherwise(0)
    return parts.withColumn("_cut", cut).withColumn("run", F.sum("_cut").over(line)).drop("_cut")


def long_runs(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weak points with their ``run`` and its seeds ``n_seed``."""
    parts = cut_lineage(stitched_runs(points, keys))
    seeds = parts.groupBy(*keys, "run").agg(F.sum("n_seed").alias("n_seed"))
    number = parts.select(*keys, "_seg", "_run", "run").join(seeds, [*keys, "run"])
    return join_small(points, number, [*keys, "_seg", "_run"]).drop("_seg", "_run")


def detect_long_events(
    curve: DataFrame, keys: Sequence[str], cfg: DetectorConfig = DetectorConfig(), base_cfg: BaselineConfig = BaselineConfig(),
    width: float = WIDTH, hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """The events of :func:`detect.detect_events` with a global level, for curves with keys, mjd, val, err of any length."""
    parts = stitched_runs(weak_points(curve, keys, cfg, base_cfg, width, hot_rows), keys)
    runs = parts.groupBy(*keys, "run").agg(
        F.min("_a").alias("mjd_start"), F.max("_b").alias("mjd_end"), F.sum("n_points").alias("n_points"), F.sum("n_seed").alias("n_seed"),
        F.max("_top").alias("_top"), F.max("base").alias("baseline_value"), F.max("sigma").alias("_sig"), F.sum("_sw").alias("_sw"),
        F.sum("_swv").alias("_swv"), F.max("_zmax").alias("significance_sigma"), F.sum("_zsum").alias("_zsum"), F.max("min_dur").alias("_min_dur"))
    pooled = F.hypot(F.sqrt(1.0 / F.col("_sw")), F.col("_sig"))
    runs = runs.withColumn("duration_days", F.col("mjd_end") - F.col("mjd_start")).withColumn(
        "block_z", (F.col("_swv") / F.col("_sw") - F.col("baseline_value")) / pooled)
    runs = runs.where(
        (F.col("n_seed") >= cfg.min_seed_points) & (F.col("n_points") >= cfg.min_points) & (F.col("duration_days") >= F.col("_min_dur"))
        & (F.col("block_z") > cfg.nsigma_exit))
    ordinal = F.row_number().over(Window.partitionBy(*keys).orderBy("mjd_start"))
    return runs.select(
        *keys, ordinal.cast("long").alias("outburst_id"), "mjd_start", "mjd_end", "duration_days", "n_points",
        F.col("_top.val").alias("peak_value"), (-F.col("_top.col2")).alias("peak_mjd"), "baseline_value", "significance_sigma",
        (F.col("_zsum") / F.col("n_points")).alias("mean_significance_sigma"), "block_z")
