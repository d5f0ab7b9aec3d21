"""Stored tables that runs add to: spans by source, and curves by range of days.

Both replace whole partitions. New contents of a partition are written to the shared checkpoint folder
before the partition is touched, so a run that fails while it computes leaves the store as it was, and a run that
is repeated gives the same store.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BROADCAST_ROWS
from ..session import cut_lineage

SPANS = "source string, t_start double, t_end double, _part int"


def _key(name: str = "source"):
    return F.upper(F.trim(F.col(name)))


class SpanStore:
    """Spans of sources in ``parts`` folders by hash of the source, case and outer blanks ignored.

    A source that was looked at and has no span is kept as one row without times, a miss, so that later runs do
    not look again (:func:`..streaming.incremental.pending`).
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64):
        self.spark, self.folder, self.parts = spark, folder, parts

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(SPANS).parquet(self.folder)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SPANS)

    def spans(self) -> DataFrame:
        return self._rows().where("t_start IS NOT NULL").drop("_part")

    def misses(self) -> DataFrame:
        return self._rows().where("t_start IS NULL").select("source")

    def seen(self) -> DataFrame:
        """Sources that need no new look: with spans or recorded as a miss."""
        return self._rows().select("source").distinct()

    def replace(self, spans: DataFrame, looked_at: DataFrame | None = None) -> None:
        """Spans (source, t_start, t_end) take the place of all stored ones of their source.

        ``looked_at`` (source) may name further sources; those without a span become misses. Only the parts of
        the named sources are read and written."""
        new = spans.select(F.trim("source").alias("source"), F.col("t_start").cast("double").alias("t_start"), F.col("t_end").cast("double").alias("t_end"))
        new = new.where("source IS NOT NULL AND t_start IS NOT NULL")
        if looked_at is not None:
            named = looked_at.select(F.trim("source").alias("source")).where("source IS NOT NULL")
            empty = named.withColumn("_k", _key()).dropDuplicates(["_k"]).join(new.select(_key().alias("_k")).distinct(), "_k", "left_anti")
            new = new.unionByName(empty.select("source", F.lit(None).cast("double").alias("t_start"), F.lit(None).cast("double").alias("t_end")))
        part = F.pmod(F.xxhash64(_key()), F.lit(self.parts)).cast("int")
        new = cut_lineage(new.withColumn("_part", part))
        touched = [r[0] for r in new.select("_part").distinct().collect()]  # at most ``parts``
        if not touched:
            return
        kept = self._rows().where(F.col("_part").isin(touched)).withColumn("_k", _key())
        kept = kept.join(new.select(_key().alias("_k")).distinct(), "_k", "left_anti").drop("_k")
        rows = cut_lineage(kept.unionByName(new))
        rows.repartition("_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(self.folder)


def store_by_range(curves: DataFrame, folder: str, days: float, time: str = "mjd") -> None:
    """Curves in folders of ``days`` days; ranges that ``curves`` has are replaced, others stay.

    A dense range is several files, as many as adaptive execution makes of it."""
    rows = curves.withColumn("_range", F.floor(F.col(time) / F.lit(days)).cast("long")).where("_range IS NOT NULL")
    rows = rows.hint("rebalance", "_range")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_range").parquet(folder)


def scan_chunks(spark: SparkSession, folder: str, chunks: DataFrame, days: float, time: str = "mjd", closed: bool = False) -> DataFrame:
    """Rows of a store by range in time chunks (start, end, other columns of a chunk), each with its chunk.

    Files of other ranges are pruned at run time by the ranges of the chunks. Chunks are half-open, so
    that a row on the border of two is read once; ``closed`` takes the end too, as separate requests for
    each chunk do.
    """
    stored = spark.read.parquet(folder)
    last = F.col("end") if closed else F.col("end") - F.lit(1e-12)
    ranges = F.sequence(F.floor(F.col("start") / F.lit(days)), F.floor(last / F.lit(days)))
    wanted = cut_lineage(chunks.withColumn("_range", F.explode(ranges)).withColumn("_range", F.col("_range").cast(stored.schema["_range"].dataType)))
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    wanted = wanted.where("end >= start")  # a filter on this side makes Spark prune by it
    inside = (F.col(time) >= F.col("start")) & ((F.col(time) <= F.col("end")) if closed else (F.col(time) < F.col("end")))
    return stored.join(F.broadcast(wanted) if few else wanted, "_range").where(inside).drop("_range")


def even_chunks(spark: SparkSession, start: float, end: float, days: float) -> DataFrame:
    """start, end of consecutive chunks from ``start`` on, the last one cut at ``end``; one at least."""
    n = max(int(-(-(end - start) // days)), 1)
    k = F.col("id").cast("double")
    return spark.range(n).select((start + k * days).alias("start"), F.least(start + (k + 1) * days, F.lit(max(end, start))).alias("end"))

