"""Light-curve, span and classification files to the engine's tables.

All readers take a folder or glob: one scan for each distinct header, never one frame per file;
columns are resolved by name for each header. The source comes from the file name in the
``_metadata`` column, and the file itself is part of a series' key.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FitConfig
from ..functions import photometry as ph
from ..functions.coords import DEC_COLUMNS, RA_COLUMNS, with_position
from ..functions.expr import no_nan
from ..functions.names import canonical_key, class_label, parse_curve_file
from ..operators.rebin import dedupe_exact, rebin_series
from ..operators.skew import join_small, split_join
from ..schema import MAG_KEYWORDS, SPAN_END, SPAN_START, by_keyword, by_name, need, standard_energy_band, tidy_header
from .headed import FILE, ORDER, PATH, read_headed

KEYS = ["source", "file_stem", "instrument", "band", "file"]
XRAY_BAND = "2-20keV"


def number(name: str):
    return no_nan(F.trim(F.col(f"`{name}`")).try_cast("double"))


def raw_xray(spark: SparkSession, path: str, glob: str = "*_maxi*") -> DataFrame:
    def pick(df: DataFrame) -> DataFrame:
        t = need(df, ["mjd"], "time")
        df = standard_energy_band(df)
        return parse_curve_file(df, FILE).select(
            "source", "file_stem", "instrument", F.lit(XRAY_BAND).alias("band"), F.col(FILE).alias("file"),
            number(t).alias("mjd"), number("flux_2_20").alias("val"), number("err_2_20").alias("err"),
        )

    return read_headed(spark, path, pick, glob).where("mjd IS NOT NULL AND val IS NOT NULL AND err > 0")


def load_xray(spark: SparkSession, path: str, glob: str = "*_maxi*") -> DataFrame:
    """Clean X-ray curves, daily where dense, exact-merged where sparse."""
    return rebin_series(raw_xray(spark, path, glob), KEYS)


def clean_optical(df: DataFrame, keys: list[str], min_rows: int = 10) -> DataFrame:
    """Good, positive-error magnitudes to relative flux; bands with too few rows drop out.

    ``df`` has keys, mjd, mag, magerr and optionally catflags.
    """
    if "catflags" in df.columns:
        df = df.where("catflags = 0")
    df = df.where("mjd IS NOT NULL AND mag IS NOT NULL AND magerr > 0")
    enough = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows)
    df = join_small(df, enough.drop("_n"), keys)
    flux = df.select(
        *keys, "mjd", ph.relative_flux(F.col("mag")).alias("val"),
        ph.relative_flux_err(F.col("mag"), F.col("magerr")).alias("err"),
    )
    return dedupe_exact(flux, keys)


def load_optical_bands(spark: SparkSession, path: str, glob: str = "*_ztf*") -> DataFrame:
    def pick(df: DataFrame) -> DataFrame:
        cols = {n: need(df, [n], n) for n in ("mjd", "mag", "magerr", "filtercode")}
        flag = by_name(df.columns, ["catflags"])
        return parse_curve_file(df, FILE).select(
            "source", "file_stem", "instrument", F.col(cols["filtercode"]).alias("band"), F.col(FILE).alias("file"),
            *[number(cols[n]).alias(n) for n in ("mjd", "mag", "magerr")],
            # a file without quality flags has good rows only
            (number(flag) if flag else F.lit(0.0)).alias("catflags"),
        )

    return clean_optical(read_headed(spark, path, pick, glob), KEYS)


def filter_of_id(fid):
    """Filter of a numeric filter id: 1 is g, 2 is r; others stay as they are."""
    n = fid.try_cast("double")
    return F.when(n == 1, "g").when(n == 2, "r").otherwise(fid.cast("string"))


def load_magnitudes(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Tolerant magnitude reader: columns by keyword, default error 0.05, filter lower-cased.

    Files without a time or magnitude column are left out."""
    def pick(df: DataFrame) -> DataFrame | None:
        names = [c for c in df.columns if c not in (FILE, PATH, ORDER)]
        cols = {k: by_keyword(names, words) for k, words in MAG_KEYWORDS.items()}
        if cols["mjd"] is None or cols["mag"] is None:
            return None
        err = number(cols["magerr"]) if cols["magerr"] else F.lit(0.05)
        filt = F.lower(F.trim(F.col(f"`{cols['filter']}`"))) if cols["filter"] else F.lit("unknown")
        if cols["filter"] and cols["filter"].strip().lower() == "fid":
            filt = filter_of_id(filt)
        return df.select(
            FILE, number(cols["mjd"]).alias("mjd"), number(cols["mag"]).alias("mag"),
            err.alias("magerr"), filt.alias("filter"),
        )

    return read_headed(spark, path, pick, glob).where("mjd IS NOT NULL AND mag IS NOT NULL")


def load_hardness(spark: SparkSession, path: str, glob: str = "*_maxi*") -> DataFrame:
    """Cleaned flux ratio per scan."""
    wanted = ["mjd", "flux_4_10", "err_4_10", "flux_10_20", "err_10_20", "flux_2_20"]

    def pick(df: DataFrame) -> DataFrame:
        df = tidy_header(df)
        for c in ("mjd", "flux_4_10", "flux_10_20"):
            need(df, [c], c)
        cols = {c: by_name(df.columns, [c, c.replace("err_", "error_")]) for c in wanted}
        return df.select(FILE, *[(number(k) if k else F.lit(None).cast("double")).alias(c) for c, k in cols.items()])

    df = read_headed(spark, path, pick, glob).where("mjd IS NOT NULL AND flux_4_10 > 0 AND flux_10_20 > 0")
    for b in ("4_10", "10_20"):
        df = df.where(f"err_{b} IS NULL OR abs(err_{b} / flux_{b}) <= 1")
    hr, err = ph.hardness(F.col("flux_4_10"), F.col("flux_10_20"), F.col("err_4_10"), F.col("err_10_20"))
    return df.withColumn("hr_x", hr).withColumn("hr_x_err", err)


def load_spans(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Span files of any of the known layouts."""
    return read_headed(spark, path, spans_of, glob)


def spans_of(df: DataFrame) -> DataFrame:
    """source, t_start, t_end under any of the known column spellings; bad spans dropped."""
    df = tidy_header(df)
    start, end = need(df, SPAN_START, "span start"), need(df, SPAN_END, "span end")
    out = df.select(F.trim("source").alias("source"), number(start).alias("t_start"), number(end).alias("t_end"))
    finite = (F.abs("t_start") < float("inf")) & (F.abs("t_end") < float("inf"))
    return out.where(finite & (F.col("t_end") > F.col("t_start")))


def first_stored_spans(candidates: list[DataFrame]) -> DataFrame:
    """Per source the spans of the first candidate table that has any, de-duplicated."""
    tagged = None
    for i, df in enumerate(candidates):
        one = spans_of(df).withColumn("_rank", F.lit(i))
        tagged = one if tagged is None else tagged.unionByName(one)
    return best_rank(tagged.withColumn("source", F.upper("source")), ["source"], "_rank").dropDuplicates()


def best_rank(df: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Rows that carry the smallest rank of their key."""
    best = df.groupBy(*keys).agg(F.min(rank).alias("_best"))
    return split_join(df, best, keys).where(F.col(rank) == F.col("_best")).drop("_best", rank)


def upsert_spans(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Spans of every source in ``new`` replace the stored ones."""
    key = F.upper(F.trim("source"))
    names = new.select(key.alias("_k")).distinct()
    kept = existing.withColumn("_k", key).join(names, "_k", "left_anti").drop("_k")
    return kept.unionByName(new)


def qualified_outbursts(
    catalog: DataFrame, instrument: str, band_tag: str, min_points: int = FitConfig().min_catalog_points,
    min_days: float = FitConfig().min_duration_days,
) -> DataFrame:
    """Catalogued events worth a fit: instrument and band match (case and blanks ignored)."""
    band = F.lower(F.regexp_replace("band", " ", ""))
    return catalog.where(
        (F.lower("instrument") == instrument.lower())
        & (band == band_tag.replace(" ", "").lower())
        & (F.col("n_points") >= min_points)
        & (F.col("duration_days") >= min_days)
    )


def load_outbursts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Event files: file_stem, instrument, band, outburst_id, mjd_start, mjd_end, n_points, duration_days.

    A file without durations gets them from its times; rows without times drop out."""
    def pick(df: DataFrame) -> DataFrame:
        df = tidy_header(df)
        text = {c: need(df, [c], c) for c in ("file_stem", "instrument", "band")}
        start, end, size = need(df, ["mjd_start", "span_start_mjd"], "event start"), need(df, ["mjd_end", "span_end_mjd"], "event end"), need(df, ["n_points"], "size")
        ordinal, length = by_name(df.columns, ["outburst_id", "outburst_idx"]), by_name(df.columns, ["duration_days"])
        took = number(end) - number(start)
        return df.select(
            *[F.trim(F.col(f"`{c}`")).alias(n) for n, c in text.items()], (number(ordinal) if ordinal else F.lit(None)).cast("long").alias("outburst_id"),
            number(start).alias("mjd_start"), number(end).alias("mjd_end"), number(size).cast("long").alias("n_points"),
            (F.coalesce(number(length), took) if length else took).alias("duration_days"))

    return read_headed(spark, path, pick, glob).where("mjd_start IS NOT NULL AND mjd_end IS NOT NULL")


def load_classification(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """ckey, raw_name, compact_object, src_type; the last row of a key wins, files in order of path."""
    def pick(df: DataFrame) -> DataFrame | None:
        names = [c for c in df.columns if c not in (FILE, PATH, ORDER)]
        name = by_keyword(names, ["source", "name"])
        obj = by_keyword(names, ["compact", "bh_ns", "object_type", "co_type"])
        kind = by_keyword(names, ["src_type", "xrb_type", "type"])
        if name is None:
            return None
        return df.where(F.col(f"`{name}`").isNotNull()).select(
            canonical_key(F.col(f"`{name}`")).alias("ckey"), F.col(f"`{name}`").alias("raw_name"),
            (class_label(F.col(f"`{obj}`")) if obj else F.lit("UNKNOWN")).alias("compact_object"),
            (F.coalesce(F.upper(F.col(f"`{kind}`")), F.lit("UNKNOWN")) if kind else F.lit("UNKNOWN")).alias("src_type"), ORDER,
        )

    rows = read_headed(spark, path, pick, glob)
    last = rows.groupBy("ckey").agg(F.max_by(F.struct("raw_name", "compact_object", "src_type"), ORDER).alias("r"))
    return last.select("ckey", "r.*")


def union_files(spark: SparkSession, master: str, fallback_glob: str) -> DataFrame:
    """The master summary if it exists, else the union of the per-source files; columns by name."""
    try:
        df = read_headed(spark, master)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df = read_headed(spark, fallback_glob)
    return df.drop(FILE, PATH, ORDER)


def load_catalog(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Catalog tables under any of the known position columns: ra and dec in degrees, decimal or
    sexagesimal, before all other columns as text. Rows without a position drop out."""
    def pick(df: DataFrame) -> DataFrame | None:
        ra, dec = by_name(df.columns, RA_COLUMNS), by_name(df.columns, DEC_COLUMNS)
        if ra is None or dec is None:
            return None
        rest = [F.col(f"`{c}`") for c in df.columns if c not in (ra, dec, FILE, PATH, ORDER)]
        df = df.select(F.col(f"`{ra}`").alias("_ra_text"), F.col(f"`{dec}`").alias("_dec_text"), *rest)
        return with_position(df, "_ra_text", "_dec_text").drop("_ra_text", "_dec_text")

    return read_headed(spark, path, pick, glob).where("ra IS NOT NULL AND dec IS NOT NULL")
