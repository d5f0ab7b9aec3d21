"""Writers. Partitioned files of the whole result; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- Fixed values: column order of the review and result files ----
REVIEW_COLUMNS = [
    "raw_filename", "core_identifier", "query_name", "query_name_alt", "sign_ambiguous", "source_key",
    "band", "instrument", "confidence", "notes",
]
OUTBURST_COLUMNS = [
    "source", "file_stem", "instrument", "band", "outburst_id", "mjd_start", "mjd_end", "duration_days",
    "n_points", "peak_value", "peak_mjd", "baseline_value", "significance_sigma", "fap_empirical",
    "candidate_periodic", "best_period_days", "period_fap", "spacing_cv",
]
# --------------------------------------------------------------------


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """Headed CSV in a fixed column order. An empty result still has its header row."""
    out = df.select(*columns) if columns else df
    out.write.mode(mode).option("header", True).csv(path)


def write_outbursts(df: DataFrame, path: str) -> None:
    """Event records in their file order of columns."""
    write_csv(df, path, OUTBURST_COLUMNS)


def write_review(df: DataFrame, path: str) -> None:
    """Parsed names for review."""
    write_csv(df, path, REVIEW_COLUMNS)


def _log_line():
    return F.format_string(
        "%s %s #%d  MJD %.4f to %.4f  A=%.6e t0=%.4f tau1=%.4f tau2=%.4f W=%.4f  chi2=%.4f dof=%d aic=%.4f  T90=%.4f",
        "source", "band", "outburst_idx", "span_start_mjd", "span_end_mjd", "A", "t0", "tau1", "tau2", "width",
        "chi2", "dof", "aic", "t90",
    ).alias("value")


def write_log(df: DataFrame, path: str) -> None:
    """One text line per fitted event; the lines of a source are in one file, in order."""
    rows = df.repartition("source").sortWithinPartitions("source", "band", "outburst_idx")
    rows.select(_log_line()).write.mode("overwrite").text(path)


def write_source_logs(df: DataFrame, path: str) -> None:
    """The same lines with a folder for each source; sources that are not in ``df`` keep their log."""
    rows = df.withColumn("_source", F.col("source")).repartition("_source").sortWithinPartitions("_source", "band", "outburst_idx")
    rows.select("_source", _log_line()).withColumnRenamed("_source", "log").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("log").text(path)
