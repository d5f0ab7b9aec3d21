"""Robust quiescent level and scatter of a rebinned series.

Input is a rebinned series (bounded, see ``rebin``), so one window partition per
series is safe. All steps share a single exchange and sort on the series keys.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import BaselineConfig


def _centre(df: DataFrame, w, cfg: BaselineConfig) -> DataFrame:
    """Median and scatter of the rows under ``_mask``."""
    kept = lambda c: F.when(F.col("_mask"), c)
    df = df.withColumn("_med", F.median(kept(F.col("val"))).over(w))
    df = df.withColumn("_dev", F.abs(F.col("val") - F.col("_med")))
    return df.withColumn(
        "_scat",
        F.greatest(
            cfg.mad_scale * F.median(kept(F.col("_dev"))).over(w),
            F.median(kept(F.col("err"))).over(w),
        ),
    )


def baseline_global(
    series: DataFrame, keys: Sequence[str], cfg: BaselineConfig = BaselineConfig()
) -> DataFrame:
    """Adds ``base``, ``sigma`` and ``quiet`` from one-sided iterative clipping.

    Low points are never clipped. A series stops when fewer than ``min_points`` rows
    remain or when the number of kept rows no longer changes; the stop flag is carried
    because later passes could still swap members at an equal count.
    """
    w = Window.partitionBy(*keys)
    df = series.withColumn("_mask", F.lit(True)).withColumn("_stop", F.lit(False))
    df = df.withColumn("_cnt", F.count("*").over(w))
    for _ in range(cfg.n_iter):
        df = _centre(df, w, cfg)
        inside = (F.col("_dev") <= cfg.clip_sigma * F.col("_scat")) | (F.col("val") < F.col("_med"))
        hold = F.col("_stop") | (F.col("_cnt") < cfg.min_points)
        df = df.withColumn("_new", F.when(hold, F.col("_mask")).otherwise(inside))
        df = df.withColumn("_ncnt", F.sum(F.col("_new").cast("long")).over(w))
        df = (
            df.withColumn("_stop", hold | (F.col("_ncnt") == F.col("_cnt")))
            .withColumn("_mask", F.col("_new"))
            .withColumn("_cnt", F.col("_ncnt"))
        )
    df = _centre(df, w, cfg)
    return df.select(
        *series.columns,
        F.col("_med").alias("base"),
        F.col("_scat").alias("sigma"),
        F.col("_mask").alias("quiet"),
    )


class SlidingRanks:
    """Sorted values of a moving window: insert, delete, median, median distance from a point."""

    def __init__(self):
        self.values: list[float] = []

    def add(self, value: float) -> None:
        insort(self.values, value)

    def drop(self, value: float) -> None:
        del self.values[bisect_left(self.values, value)]

    def median(self) -> float:
        n = len(self.values)
        return (self.values[(n - 1) // 2] + self.values[n // 2]) / 2

    def _distance(self, k: int, centre: float) -> float:
        """The k-th smallest distance from ``centre``: the k nearest values stand side by side."""
        a, low, high = self.values, 0, len(self.values) - k
        while low < high:
            mid = (low + high) // 2
            if abs(centre - a[mid]) > abs(a[mid + k] - centre):
                low = mid + 1
            else:
                high = mid
        return max(abs(centre - a[low]), abs(a[low + k - 1] - centre))

    def median_distance(self, centre: float) -> float:
        n = len(self.values)
        return (self._distance((n + 1) // 2, centre) + self._distance(n // 2 + 1, centre)) / 2


def _slide(half: float, width: float, cfg: BaselineConfig):
    """Kernel for the rows of one segment and their neighbours: local level of the segment's own rows."""

    def run(rows):
        rows = rows.sort_by("mjd")
        t, val, err, quiet, base, sigma = (rows.column(c).to_pylist() for c in ("mjd", "val", "err", "quiet", "base", "sigma"))
        seg = rows.column("_seg")[0].as_py()
        values, errors, low, high, own = SlidingRanks(), SlidingRanks(), 0, 0, []
        for i, at in enumerate(t):
            if at // width != seg:
                continue
            own.append(i)
            while high < len(t) and t[high] <= at + half:
                if quiet[high]:
                    values.add(val[high]), errors.add(err[high])
                high += 1
            while t[low] < at - half:
                if quiet[low]:
                    values.drop(val[low]), errors.drop(err[low])
                low += 1
            if len(values.values) >= cfg.rolling_min_points:
                base[i] = values.median()
                sigma[i] = max(cfg.mad_scale * values.median_distance(base[i]), errors.median())
        for name, values in (("base", base), ("sigma", sigma)):
            i = rows.schema.get_field_index(name)
            rows = rows.set_column(i, rows.schema.field(i), pa.array(values, pa.float64()))
        return rows.take(pa.array(own, pa.int64())).drop_columns(["_seg"])

    return run


def baseline_rolling(
    series: DataFrame,
    keys: Sequence[str],
    window_days: float,
    cfg: BaselineConfig = BaselineConfig(),
) -> DataFrame:
    """Level and scatter in a closed time window around each row.

    Only globally quiet rows count; rows whose window holds fewer than
    ``rolling_min_points`` of them take the global values. A task gets a stretch of four windows of one
    series with half a window on either side, and moves the window over it by insert and delete.
    """
    df = baseline_global(series, keys, cfg).select(*series.columns, "base", "sigma", "quiet")
    half, width = window_days / 2.0, 4.0 * window_days
    reach = half + 1e-6  # the kernel draws the exact line
    first, last = (F.floor((F.col("mjd") + d) / F.lit(width)) for d in (-reach, reach))
    near = df.withColumn("_seg", F.explode(F.sequence(first, last)))
    return near.groupBy(*keys, "_seg").applyInArrow(_slide(half, width, cfg), df.schema)
