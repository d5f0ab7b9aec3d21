"""Views that give the driver's tables the shape of light curves, catalogs and names.

Everything is a projection of one scan, so column pruning and filters reach Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mjd_of(ts: str):
    """Zone-free MJD of a timestamp without time zone."""
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")
    return micros / F.lit(8.64e10) + F.lit(40587.0)


def lightcurve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, band, mjd, val, err, row_id: one row per event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("source"),
        F.col("event_type").alias("band"),
        mjd_of("ts").alias("mjd"),
        F.col("value").alias("val"),
        (F.col("value") * 0.1 + 0.5).alias("err"),
        F.col("event_id").alias("row_id"),
    )


def optical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes per filter with quality flags, from the click events."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    return e.select(
        F.col("user_id").alias("source"),
        mjd_of("ts").alias("mjd"),
        (F.lit(14.0) + F.col("value") / 50.0).alias("mag"),
        (F.lit(0.02) + F.col("value") / 5000.0).alias("magerr"),
        F.element_at(
            F.array(F.lit("zg"), F.lit("zr"), F.lit("zi")), (F.col("event_id") % 3 + 1).cast("int")
        ).alias("filtercode"),
        F.when(F.col("event_id") % 11 == 0, 32768)
        .when(F.col("event_id") % 7 == 0, 4)
        .otherwise(0)
        .cast("long")
        .alias("catflags"),
        F.col("event_id").alias("row_id"),
    )


def xray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-ray flux series, from the view events."""
    return lightcurve(spark, sf_dir).where("band = 'view'").select(
        "source", "mjd", F.col("val").alias("xf"), F.col("err").alias("xe"), "row_id"
    )


def multiband(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide daily table source, mjd, flux/err per energy band (NULL where unobserved)."""
    lc = lightcurve(spark, sf_dir)
    bands = {"2_4": "view", "4_10": "click", "10_20": "purchase"}
    aggs = []
    for label, kind in bands.items():
        hit = F.col("band") == kind
        aggs.append(F.avg(F.when(hit, F.col("val"))).alias(f"flux_{label}"))
        aggs.append(F.avg(F.when(hit, F.col("err"))).alias(f"err_{label}"))
    aggs += [F.avg("val").alias("flux_2_20"), F.avg("err").alias("err_2_20")]
    return lc.groupBy("source", (F.floor("mjd") + 0.5).alias("mjd")).agg(*aggs)


# Golden-angle sphere: row k of a table gets a fixed, evenly spread position.
GOLDEN_DEG = 137.50776
GOLDEN_FRAC = 0.6180339887


def sphere(k, ra_name: str = "ra", dec_name: str = "dec", dra=0.0, ddec=0.0):
    """Base position of key ``k`` plus small offsets in degrees."""
    turn = k * F.lit(GOLDEN_DEG) + dra
    part = k * F.lit(GOLDEN_FRAC)
    ra = turn - 360.0 * F.floor(turn / 360.0)
    z = 2.0 * (part - F.floor(part)) - 1.0
    return [ra.alias(ra_name), (F.degrees(F.asin(z)) + ddec).alias(dec_name)]
