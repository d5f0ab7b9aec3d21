"""Sky coordinates as column expressions: separation, parsing, names that hold positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import fence

# ---- Fixed values ----
BLANK_TOKENS = ["", "--", "nan", "none", "masked", "n/a"]
RA_COLUMNS = ["RAJ2000", "RA_ICRS", "RAdeg", "RA"]
DEC_COLUMNS = ["DEJ2000", "DE_ICRS", "DEdeg", "DEC"]
J_NAME = r"J(\d{4,6}(?:\.\d+)?)([+-])(\d{2,6}(?:\.\d+)?)"
PLAIN_NAME = r"(\d{2})(\d{2}(?:\.\d+)?)\s*([+-])(\d{2,3}(?:\.\d+)?)\s*$"
SHORT_J_NAME = r"J(\d{2})(\d{2})([+-]\d+)"
# arcsec that one step of the last declination digit stands for, by digit count
DEC_STEP = {2: 3600.0, 3: 360.0, 4: 60.0, 5: 6.0, 6: 1.0}
# ----------------------

ARCSEC_PER_RAD = 206264.80624709636


def separation_sql(ra1: str, dec1: str, ra2: str, dec2: str) -> str:
    """Great-circle distance in arcsec by haversine, stable at arcsecond scale."""
    return (
        f"2.0 * asin(sqrt(least(1.0D, pow(sin(radians({dec2} - {dec1}) / 2), 2) + cos(radians({dec1})) * "
        f"cos(radians({dec2})) * pow(sin(radians({ra2} - {ra1}) / 2), 2)))) * {ARCSEC_PER_RAD}D"
    )


def is_blank(text: Column) -> Column:
    return text.isNull() | F.lower(F.trim(text)).isin(BLANK_TOKENS)


def with_position(df: DataFrame, ra: str, dec: str, out_ra: str = "ra", out_dec: str = "dec") -> DataFrame:
    """Adds degrees from decimal or sexagesimal text, decided per row; NULL if blank.

    Sexagesimal right ascension is in hours. The sign is that of the text, so -00 30 00
    stays negative.
    """
    df = df.withColumns({"_r": F.trim(ra), "_d": F.trim(dec)})
    df = df.withColumn("_bad", is_blank(F.col("_r")) | is_blank(F.col("_d")))
    df = df.withColumn("_six", F.col("_r").rlike(r"[\s:]"))
    split = lambda c: F.split(F.regexp_replace(c, r"[hdms:\s]+", " "), " ")
    df = df.withColumns({"_rp": split("_r"), "_dp": split("_d")})
    part = lambda c, i: F.coalesce(F.abs(F.get(c, F.lit(i)).try_cast("double")), F.lit(0.0))
    df = df.withColumns(
        {f"{c}{i}": part(c, i) for c in ("_rp", "_dp") for i in range(3)}
    )
    size = lambda c: F.col(f"{c}0") + F.col(f"{c}1") / 60.0 + F.col(f"{c}2") / 3600.0
    sign = F.when(F.col("_d").startswith("-"), -1.0).otherwise(1.0)
    six = F.struct((size("_rp") * 15.0).alias("ra"), (sign * size("_dp")).alias("dec"))
    plain = F.struct(F.col("_r").try_cast("double").alias("ra"), F.col("_d").try_cast("double").alias("dec"))
    df = fence(df, "_pos", F.when(~F.col("_bad"), F.when(F.col("_six"), six).otherwise(plain)))
    df = df.withColumns({out_ra: F.col("_pos.ra"), out_dec: F.col("_pos.dec")})
    helpers = ["_r", "_d", "_bad", "_six", "_rp", "_dp", "_pos"]
    return df.drop(*helpers, *[f"{c}{i}" for c in ("_rp", "_dp") for i in range(3)])


def _num(text: Column) -> Column:
    return text.try_cast("double")


def _fraction_digits(block: Column) -> Column:
    return F.length(F.regexp_extract(block, r"\.(\d+)$", 1))


def with_j_position(df: DataFrame, name: str, out: str = "j") -> DataFrame:
    """Adds struct(ra, dec, precision) of a J-style name, NULL where none can be read.

    RA digits are HHMM or HHMMSS, optionally with a fraction; declination digits are DD,
    DDd, DDMM, DDMMm or DDMMSS. ``precision`` is the coarser of the two last-digit steps in
    arcsec. Built in stages so that no expression is repeated inside another.
    """
    df = df.withColumns(
        {n: F.regexp_extract(name, J_NAME, i) for i, n in enumerate(("_rb", "_sg", "_db"), 1)}
    )
    df = df.withColumns(
        {
            "_rn": F.length(F.substring_index("_rb", ".", 1)),
            "_rstep": F.pow(F.lit(10.0), -_fraction_digits(F.col("_rb")).cast("double")),
            "_hh": _num(F.substring("_rb", 1, 2)),
            "_mm": _num(F.substring("_rb", 3, 2)),
            "_mf": _num(F.substring("_rb", 3, 64)),
            "_sf": _num(F.substring("_rb", 5, 64)),
            "_dn": F.length(F.substring_index("_db", ".", 1)),
            "_d1": _num(F.substring("_db", 1, 2)),
            "_d3": _num(F.substring("_db", 3, 1)),
            "_d34": _num(F.substring("_db", 3, 2)),
            "_d5": _num(F.substring("_db", 5, 1)),
            "_df": _num(F.substring("_db", 3, 64)),
            "_ds": _num(F.substring("_db", 5, 64)),
        }
    )
    hh, mm, mf, sf = (F.col(c) for c in ("_hh", "_mm", "_mf", "_sf"))
    four = (F.col("_rn") == 4) & (hh <= 24) & (mf <= 60)
    six = (F.col("_rn") == 6) & (hh <= 24) & (mm <= 60) & (sf <= 60)
    n, d1, d34 = F.col("_dn"), F.col("_d1"), F.col("_d34")
    size = (
        F.when(n == 2, d1)
        .when(n == 3, d1 + F.col("_d3") / 10.0)
        .when((n == 4) & (F.col("_df") <= 60), d1 + F.col("_df") / 60.0)
        .when((n == 5) & (d34 < 60), d1 + (d34 + F.col("_d5") / 10.0) / 60.0)
        .when((n == 6) & (d34 <= 60) & (F.col("_ds") <= 60), d1 + d34 / 60.0 + F.col("_ds") / 3600.0)
    )
    step = F.lit(None).cast("double")
    for digits, arcsec in DEC_STEP.items():
        step = F.when(n == digits, arcsec).otherwise(step)
    df = df.withColumns(
        {
            "_hours": F.when(four, hh + mf / 60.0).when(six, hh + mm / 60.0 + sf / 3600.0),
            "_tstep": F.when(four, 60.0 * F.col("_rstep")).when(six, F.col("_rstep")),
            "_size": size,
            "_dstep": step,
        }
    )
    df = df.withColumn("_ok", F.col("_hours").isNotNull() & (F.col("_size") <= 90))
    on_sky = F.abs(F.col("_tstep") * 15.0 * F.cos(F.radians("_size")))
    pos = F.struct(
        F.pmod(F.col("_hours") * 15.0, F.lit(360.0)).alias("ra"),
        F.when(F.col("_sg") == "-", -F.col("_size")).otherwise(F.col("_size")).alias("dec"),
        F.greatest(on_sky, F.col("_dstep")).alias("precision"),
    )
    df = fence(df, out, F.when(F.col("_ok"), pos))
    return df.drop(
        "_rb", "_sg", "_db", "_rn", "_rstep", "_hh", "_mm", "_mf", "_sf", "_dn", "_d1", "_d3",
        "_d34", "_d5", "_df", "_ds", "_hours", "_tstep", "_size", "_dstep", "_ok",
    )


def with_plain_candidates(df: DataFrame, name: str, out: str = "c") -> DataFrame:
    """Adds an array of struct(ra, dec, label): every reading of a catalog name without J.

    Two declination digits are whole degrees; three may be tenths or a surplus digit, so
    both readings are kept.
    """
    df = df.withColumn("_t", F.trim(F.col(name)))
    df = df.withColumns(
        {n: F.regexp_extract("_t", PLAIN_NAME, i) for i, n in enumerate(("_h", "_m", "_s", "_d"), 1)}
    )
    df = df.withColumns(
        {
            "_hh": _num(F.col("_h")), "_mm": _num(F.col("_m")), "_dd": _num(F.col("_d")),
            "_n": F.length(F.substring_index("_d", ".", 1)), "_d2": _num(F.substring("_d", 1, 2)),
            "_f": F.when(F.col("_s") == "-", -1.0).otherwise(1.0),
        }
    )
    df = df.withColumns(
        {
            "_ok": (F.col("_hh") <= 24) & (F.col("_mm") <= 60),
            "_ra": F.pmod((F.col("_hh") + F.col("_mm") / 60.0) * 15.0, F.lit(360.0)),
        }
    )

    def reading(cond, size, label):
        return F.when(
            F.col("_ok") & cond & (size <= 90),
            F.struct(F.col("_ra").alias("ra"), (F.col("_f") * size).alias("dec"), F.lit(label).alias("label")),
        )

    two, three = F.col("_n") == 2, F.col("_n") == 3
    found = F.array(
        reading(two, F.col("_dd"), "whole-degree"),
        reading(three, F.col("_dd") / 10.0, "tenths-of-degree"),
        reading(three, F.col("_d2"), "whole-degree-truncated"),
    )
    df = fence(df, out, F.array_compact(found))
    return df.drop("_t", "_h", "_m", "_s", "_d", "_hh", "_mm", "_dd", "_n", "_d2", "_f", "_ok", "_ra")


def short_j_position(name: Column) -> Column:
    """struct(ra, dec): J(hh)(mm)(+ddd), the last declination digit as tenths."""
    part = lambda i: F.regexp_extract(name, SHORT_J_NAME, i)
    raw = part(3)
    dec = F.concat(F.left(raw, F.length(raw) - 1), F.lit("."), F.right(raw, F.lit(1))).try_cast("double")
    hh, mm = _num(part(1)), _num(part(2))
    ok = name.rlike(SHORT_J_NAME) & (hh <= 24) & (mm <= 60) & (F.abs(dec) <= 90)
    ra = F.pmod((hh + mm / 60.0) * 15.0, F.lit(360.0))
    return F.when(ok, F.struct(ra.alias("ra"), dec.alias("dec")))


def above_southern_limit(dec: Column, limit: float = -30.0) -> Column:
    """Can a northern survey see this declination?"""
    return F.coalesce(dec >= limit, F.lit(False))


def has_position(ra: Column, dec: Column) -> Column:
    """A position of exactly (0, 0) stands for a missing one."""
    return F.coalesce(~((ra == 0.0) & (dec == 0.0)), F.lit(False))


def mjd_now() -> Column:
    """The current time as MJD."""
    return F.unix_micros(F.current_timestamp()) / F.lit(8.64e10) + F.lit(40587.0)
