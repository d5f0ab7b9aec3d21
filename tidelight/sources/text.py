"""Plain-text tables: whitespace or pipe separated lines with comments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import no_nan

# ---- Fixed values: positional column names ----
SCAN_COLUMNS = [
    "mjd", "flux_2_20", "err_2_20", "flux_2_4", "err_2_4", "flux_4_10", "err_4_10", "flux_10_20", "err_10_20",
]
BAT_COLUMNS = ["mjd", "count_rate", "count_rate_err"]
BAT_RAW_COLUMNS = [
    "TIME", "RATE", "ERROR", "YEAR", "DAY", "STAT_ERR", "SYS_ERR", "DATA_FLAG",
    "TIMEDEL_EXPO", "TIMEDEL_CODED", "TIMEDEL_DITHERED",
]
FLUX_SENTINEL = -900.0
RATE_SENTINEL = -90.0
# -----------------------------------------------


def split_lines(
    lines: DataFrame, names: Sequence[str], sep: str = r"\s+", comments: str = "#", keep: Sequence[str] = ()
) -> DataFrame:
    """Lines (column ``value``) to double columns by position.

    Blank and comment lines go; missing fields and text that is no number become NULL.
    """
    text = F.trim("value")
    rows = lines.where((text != "") & ~F.substring(text, 1, 1).isin(list(comments)))
    fields = F.split(text, sep)
    rows = rows.select(*keep, fields.alias("_f"))
    return rows.select(
        *keep, *[no_nan(F.trim(F.get("_f", F.lit(i))).try_cast("double")).alias(n) for i, n in enumerate(names)]
    )


def read_whitespace(spark: SparkSession, path: str, names: Sequence[str], comments: str = "#") -> DataFrame:
    return split_lines(spark.read.text(path), names, comments=comments)


def read_pipe(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Pipe tables; lines that start with a backslash are comments."""
    return split_lines(spark.read.text(path), names, sep=r"\s*\|\s*", comments="\\")


def read_headed(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whitespace tables whose first line is a header that may start with #; files of other headers join by name."""
    from . import headed

    return headed.read_headed(spark, path, None, glob, sep=None).drop(headed.FILE, headed.PATH, headed.ORDER)


def valid_scan(df: DataFrame, flux: str = "flux_2_20") -> DataFrame:
    """Rows above the missing-flux sentinel with a time."""
    return df.where((F.col(flux) > FLUX_SENTINEL) & F.col("mjd").isNotNull())


def valid_rates(df: DataFrame, rate: str = "count_rate") -> DataFrame:
    """Rows above the missing-rate sentinel with a time; count rates have a sentinel of their own."""
    return df.where((F.col(rate) > RATE_SENTINEL) & F.col("mjd").isNotNull())


def read_rates(spark: SparkSession, path: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """Count-rate tables: time, rate and error by position, comments with # or !."""
    return in_range(valid_rates(read_whitespace(spark, path, BAT_COLUMNS, comments="#!")), start, end)


def read_raw_rates(spark: SparkSession, path: str) -> DataFrame:
    """Raw count-rate tables with all their columns, by position."""
    return read_whitespace(spark, path, BAT_RAW_COLUMNS)


def in_range(df: DataFrame, start: float | None, end: float | None, time: str = "mjd") -> DataFrame:
    """Closed, optionally open-ended time cut; plain predicates reach the scan."""
    if start is not None:
        df = df.where(F.col(time) >= start)
    if end is not None:
        df = df.where(F.col(time) <= end)
    return df
