"""Finding light-curve files: listings, extension filters, first pattern wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import SCAN_EXTENSIONS, base_name, strip_extension
from ..operators.skew import first_per_key

# ---- Fixed values: order is priority ----
XRAY_PATTERNS = ["_maxi_lc.csv", "_maxi.csv", "_maxi_lc", "_maxi"]
ZTF_PATTERNS = ["_ztf_lc.csv", "_ztf.csv", "_ztf_lc", "_ztf"]
OPTICAL_PATTERNS = [
    "_atlas_lc.csv", "_atlas.csv", "_ztf_lc.csv", "_ztf.csv", "_opt_lc.csv", "_opt.csv", "_optical.csv",
]
# -----------------------------------------


def list_files(spark: SparkSession, folder: str, extensions: Sequence[str] = SCAN_EXTENSIONS) -> DataFrame:
    """path, name, size of the files in a folder with one of the extensions or with none of them
    but a known ending (``_maxi_lc``); only the listing is read, no content."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size"))
    endings = sorted({p for p in XRAY_PATTERNS + ZTF_PATTERNS if "." not in p})
    pattern = r"(?i)(\.(" + "|".join(extensions) + ")|" + "|".join(endings) + ")$"
    return files.withColumn("name", base_name(F.col("path"))).where(F.col("name").rlike(pattern))


def first_pattern(files: DataFrame, path: str, patterns: Sequence[str]) -> DataFrame:
    """source_key, path, pattern: per key the file of the earliest pattern (then by path).

    Patterns select files case-sensitively; the key is cut off without regard to case and
    only a known extension is removed, so dots inside names survive.
    """
    base = base_name(F.col(path))
    stems = sorted({p.removesuffix(".csv") for p in patterns}, key=len, reverse=True)
    key = F.regexp_replace(strip_extension(base), "(?i)(" + "|".join(stems) + ")$", "")
    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(patterns))):
        rank = F.when(base.endswith(p), i).otherwise(rank)
    found = files.select(key.alias("source_key"), F.col(path).alias("path"), rank.alias("pattern"))
    found = found.where(F.col("pattern").isNotNull())
    return first_per_key(found, ["source_key"], F.struct("pattern", "path")).select(
        "source_key", "path", F.col("pattern").cast("long").alias("pattern")
    )
