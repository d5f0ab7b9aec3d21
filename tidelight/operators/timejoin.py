"""Joins on time: points in spans, nearest neighbour with tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .skew import join_small

#: Rows of a time slice beyond which it is cut finer.
SLICE_ROWS = 100_000


def crop_to_spans(
    points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str = "mjd", pad: float = 0.0
) -> DataFrame:
    """Closed range join: one output row per (point, span holding it)."""
    joined = join_small(points, spans, keys)
    inside = (F.col(time) >= F.col("t_start") - pad) & (F.col(time) <= F.col("t_end") + pad)
    return joined.where(inside)


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    tol_days: float,
    right_order: str,
    slice_days: float = 1.0,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """For each left row the right row of the same key nearest in ``mjd``.

    Rows beyond the (inclusive) tolerance are dropped. Of two equally near rows the one
    with the smaller ``right_order`` wins. Output: the left columns, the right columns
    prefixed ``r_`` and ``dt``.

    No pairs are formed. Both sides are cut into time slices, so a key that owns most
    rows is spread over many tasks; a slice of more than ``slice_rows`` rows is cut into a power of
    two of even parts. Each slice also receives the last right row before
    it and the first one after it, taken from a per-slice summary that combines map-side
    and has one row per non-empty slice. Two running windows then carry the latest right
    row forwards and backwards over the left rows.
    """
    payload = [c for c in right.columns if c not in keys]
    rights = right.groupBy(*keys, "mjd").agg(
        F.min_by(F.struct(*payload), F.col(right_order)).alias("_r")
    )
    rights = rights.select(
        *keys, "mjd", F.lit(0).alias("_k"), "_r"
    ).withColumn("_l", F.lit(None))
    lefts = left.select(
        *keys, "mjd", F.lit(1).alias("_k"),
        F.lit(None).alias("_r"), F.struct(*left.columns).alias("_l"),
    )
    # read by the summary and by the stream
    rows = _sliced(cut_lineage(lefts.unionByName(rights)), keys, slice_days, slice_rows)

    right_time = F.when(F.col("_k") == 0, F.col("mjd"))
    summary = rows.groupBy(*keys, "_s").agg(
        F.min_by("_r", right_time).alias("_first"),
        F.max_by("_r", right_time).alias("_last"),
        F.max("_k").alias("_has_left"),
    )
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.withColumn("_p", F.last("_last", True).over(before)).withColumn(
        "_q", F.last("_first", True).over(after)
    )
    carried = carried.where("_has_left = 1").select(
        *keys, "_s", F.explode(F.array("_p", "_q")).alias("_r")
    )
    carried = carried.where(F.col("_r").isNotNull()).select(
        *keys, F.col("_r.mjd").alias("mjd"), "_s", F.lit(0).alias("_k"), "_r"
    ).withColumn("_l", F.lit(None).cast(lefts.schema["_l"].dataType))

    stream = rows.unionByName(carried)
    # right rows sort before left rows of the same instant in both directions
    fwd = Window.partitionBy(*keys, "_s").orderBy("mjd", "_k").rowsBetween(Window.unboundedPreceding, 0)
    bwd = Window.partitionBy(*keys, "_s").orderBy(F.desc("mjd"), "_k").rowsBetween(
        Window.unboundedPreceding, 0
    )
    near = stream.withColumn("_p", F.last("_r", True).over(fwd)).withColumn(
        "_q", F.last("_r", True).over(bwd)
    )
    dp = F.col("mjd") - F.col("_p.mjd")
    dq = F.col("_q.mjd") - F.col("mjd")
    use_prev = (
        F.when(F.col("_q").isNull(), True)
        .when(F.col("_p").isNull(), False)
        .when(dp != dq, dp < dq)
        .otherwise(F.col(f"_p.{right_order}") <= F.col(f"_q.{right_order}"))
    )
    near = near.where("_k = 1").withColumn("_b", F.when(use_prev, F.col("_p")).otherwise(F.col("_q")))
    near = near.withColumn("dt", F.abs(F.col("mjd") - F.col("_b.mjd"))).where(F.col("dt") <= tol_days)
    return near.select(
        *[F.col(f"_l.{c}").alias(c) for c in left.columns],
        *[F.col(f"_b.{c}").alias(f"r_{c}") for c in payload],
        "dt",
    )


def _sliced(rows: DataFrame, keys: Sequence[str], slice_days: float, slice_rows: int) -> DataFrame:
    """Adds ``_s``, the time slice of a row: numbers in order of time, fractions in crowded slices."""
    at = F.col("mjd") / slice_days
    rows = rows.withColumn("_s", F.floor(at).cast("double"))
    sizes = rows.groupBy(*keys, "_s").agg(F.count("*").alias("_n")).where(F.col("_n") > slice_rows)
    crowded = cut_lineage(sizes.select(*keys, "_s", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_n") / slice_rows))).alias("_parts")))
    if crowded.isEmpty():
        return rows
    rows = join_small(rows, crowded, [*keys, "_s"], "left")
    part = F.floor((at - F.col("_s")) * F.col("_parts")) / F.col("_parts")
    return rows.withColumn("_s", F.col("_s") + F.coalesce(part, F.lit(0.0))).drop("_parts")


def peaks(points: DataFrame, keys: Sequence[str], value: str, time: str = "mjd") -> DataFrame:
    """Per key the time and value of the first maximum of ``value``."""
    return points.groupBy(*keys).agg(
        F.max_by(time, F.struct(F.col(value), -F.col(time))).alias("peak_mjd"),
        F.max(value).alias("peak_value"),
        F.count("*").alias("n_span"),
    )


def with_peak(points: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Points joined back to the peak of their key; joined, not windowed."""
    return join_small(points, peaks(points, keys, value), keys)


def phase(time: Column, peak: Column) -> Column:
    return F.when(time <= peak, F.lit("rise")).otherwise(F.lit("decay"))
