"""Population summaries: histograms per group, class labels, tiers, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BAND_COLUMN_ALTERNATIVES, FILTER_COLUMNS, by_name
from ..session import cut_lineage
from .skew import grouped_quantiles, join_small


def equal_width_histogram(
    df: DataFrame, group: str, value: str, source: str, low: int = 4, high: int = 15
) -> DataFrame:
    """Bins per group: ``clip(n // 2, low, high)`` equal ones, the last closed.

    Groups are few and large, so counts, extrema and bin counts are map-side combined and
    the median is taken skew-safe. Empty bins are present with zero.
    """
    vals = df.select(F.col(group).alias("grp"), F.col(value).alias("v"), F.col(source).alias("src"))
    # read by every count below
    vals = cut_lineage(vals.where(F.col("grp").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v")))
    seen = vals.groupBy("grp").agg(F.countDistinct("src").alias("n_sources"))
    vals = vals.where(F.abs("v") < float("inf"))
    stats = vals.groupBy("grp").agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    stats = stats.withColumn(
        "nb", F.least(F.greatest(F.floor(F.col("n") / 2), F.lit(low)), F.lit(high)).cast("int")
    )
    # a single-valued group is widened by half a unit to each side
    flat = F.col("lo") == F.col("hi")
    stats = stats.withColumn("lo2", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))).withColumn(
        "hi2", F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))
    )
    med = grouped_quantiles(vals, ["grp"], "v", {"median": 0.5})
    stats = cut_lineage(stats)
    bins = join_small(vals, stats, ["grp"])
    width = (F.col("hi2") - F.col("lo2")) / F.col("nb")
    pos = F.floor((F.col("v") - F.col("lo2")) / width)
    counts = bins.select("grp", F.least(pos, F.col("nb") - 1).cast("int").alias("bin")).groupBy(
        "grp", "bin"
    ).agg(F.count("*").alias("cnt"))
    frame = stats.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    out = frame.join(counts, ["grp", "bin"], "left").join(med, "grp").join(seen, "grp")
    return out.select(
        F.col("grp").alias("group_value"), F.col("bin").cast("long").alias("bin"),
        (F.col("lo2") + width * F.col("bin")).alias("left_edge"),
        (F.col("lo2") + width * (F.col("bin") + 1)).alias("right_edge"),
        F.coalesce("cnt", F.lit(0)).cast("long").alias("count"), F.col("n").alias("n_outbursts"),
        "n_sources", "median",
    )


def combined_label(compact: Column, kind: Column) -> Column:
    return F.when(compact.isNotNull() & kind.isNotNull(), F.concat_ws("-", compact, kind))


def tier(has_maxi: Column, has_xray: Column, has_optical: Column, n_x: Column, n_o: Column) -> Column:
    gold = has_maxi & has_optical & (n_x >= 2) & (n_o >= 2)
    return F.when(gold, "Gold").when(has_xray & has_optical, "Silver").otherwise("Bronze")


def column_audit(df: DataFrame, col: str, expected: Sequence[str]) -> DataFrame:
    """Rows per value of ``col`` that a grouped plot would lose: unrecognised or missing."""
    kind = F.when(F.col(col).isNull(), "missing").when(~F.col(col).isin(list(expected)), "unrecognized")
    bad = df.select(kind.alias("problem"), F.coalesce(F.col(col), F.lit("")).alias("value"))
    return bad.where(F.col("problem").isNotNull()).groupBy("problem", "value").agg(
        F.count("*").alias("n_rows")
    )


def in_band(df: DataFrame, column: str = "band", pattern: str = r"2(?:\.0)?\s*-\s*20(?:\.0)?") -> DataFrame:
    """Rows whose band label fits; the column may have one of its other names. Without any, all rows."""
    found = column if column in df.columns else by_name(df.columns, BAND_COLUMN_ALTERNATIVES)
    return df.where(F.coalesce(F.col(found).cast("string").rlike(pattern), F.lit(False))) if found else df


def count_bands(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """key, n_bands: distinct filters over all tables, each under its first known filter column."""
    parts = [t.select(key, F.col(c).cast("string").alias("_f")) for t in tables if (c := by_name(t.columns, FILTER_COLUMNS))]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.where("_f IS NOT NULL").groupBy(key).agg(F.countDistinct("_f").alias("n_bands"))


def named_like(columns: Sequence[str], pattern: str) -> list[str]:
    """Columns or catalog names that contain one of the words of ``pattern``, case ignored."""
    import re

    return [c for c in columns if re.search(pattern, c, re.IGNORECASE)]
