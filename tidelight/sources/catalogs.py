"""Catalogs kept between runs, clustered by sky cell.

A catalog is written once as two tables: its rows bucketed by sub-cell, and the extents of its sub-cells
bucketed by every cell they can be met from. Both are partitioned into zones of the z axis. A cone
join with a stored catalog reads the zones its positions lie in, and shuffles the positions only: the buckets
already are what the joins ask for. A small table beside them says how they were written, so that
another session can open them without touching the raw files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sky
from ..operators.skew import split_join

ZONES = 32


@dataclass(frozen=True)
class StoredCatalog:
    """A catalog in two bucketed tables, for cone joins of one radius."""

    rows: str
    boxes: str
    radius_arcsec: float
    order: tuple[str, ...]

    def nearest(self, points: DataFrame) -> DataFrame:
        """As :func:`sky.nearest_in_cone`, per distinct position of ``points``."""
        spark = points.sparkSession
        at = sky.with_cell(points.where("ra IS NOT NULL AND dec IS NOT NULL").select("ra", "dec"), self.radius_arcsec)
        zones = [r[0] for r in at.select(_zone(F.col("_cz"), self.radius_arcsec)).distinct().collect()]  # at most ZONES + 1
        around = sorted({z + d for z in zones for d in (-1, 0, 1)})
        boxes = spark.table(self.boxes).where(F.col("_zone").isin(zones)).drop("_zone")
        rows = spark.table(self.rows).where(F.col("_zone").isin(around)).drop("_zone")
        return sky.nearest_of_parts(points, rows, boxes, self.radius_arcsec, self.order)

    def join(self, points: DataFrame, how: str = "left") -> DataFrame:
        """``points`` with their nearest catalog row within the radius."""
        return split_join(points, self.nearest(points), ["ra", "dec"], how)


def _zone(cz, radius_arcsec: float, finer: int = 1):
    """Zone of a cell, or of a cell that is ``finer`` times as fine."""
    cells = int(2.0 / (sky._chord(radius_arcsec) * ZONES)) + 1
    return F.floor(cz / F.lit(float(cells * finer))).cast("int")


def store_catalog(
    catalog: DataFrame, folder: str, name: str, radius_arcsec: float, order: Sequence[str], buckets: int | None = None
) -> StoredCatalog:
    """Write ``catalog`` (ra, dec, other columns) below ``folder``, which all executors share, and open it.

    The notes are written last: what a failed run leaves is not taken for a catalog, and is written over."""
    spark = catalog.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, boxes = sky.catalog_parts(catalog, radius_arcsec, order)
    # a sub-cell is an eighth of a cell; its rows are met from the zone of the cell or the ones beside it
    rows = rows.withColumn("_zone", _zone(F.col("_sz"), radius_arcsec, 8))
    boxes = boxes.withColumn("_zone", _zone(F.col("_cz"), radius_arcsec))
    for df, part, by in ((rows, "rows", sky.SUB), (boxes, "boxes", sky.CELL)):
        table = f"{name}_{part}"
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        df.repartition(buckets, *by).write.format("parquet").partitionBy("_zone").bucketBy(buckets, *by).sortBy(*by).option(
            "path", f"{folder}/{table}").mode("overwrite").saveAsTable(table)
    notes = [(float(radius_arcsec), int(buckets), list(order), _ddl(rows), _ddl(boxes))]
    spark.createDataFrame(notes, "radius double, buckets int, ord array<string>, row_columns string, box_columns string").coalesce(1).write.mode(
        "overwrite").parquet(f"{folder}/{name}_notes")
    return StoredCatalog(f"{name}_rows", f"{name}_boxes", float(radius_arcsec), tuple(order))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def open_catalog(spark: SparkSession, folder: str, name: str) -> StoredCatalog | None:
    """A catalog that an earlier run has written below ``folder``; None if there is none."""
    try:
        notes = spark.read.parquet(f"{folder}/{name}_notes").first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
    for part, columns, by in (("rows", notes.row_columns, sky.SUB), ("boxes", notes.box_columns, sky.CELL)):
        table = f"{name}_{part}"
        if not spark.catalog.tableExists(table):
            keys = ", ".join(by)
            spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY (_zone) CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                f"INTO {notes.buckets} BUCKETS LOCATION '{folder}/{table}'")
            spark.sql(f"MSCK REPAIR TABLE {table}")
    return StoredCatalog(f"{name}_rows", f"{name}_boxes", notes.radius, tuple(notes.ord))


def kept_catalog(
    spark: SparkSession, folder: str, name: str, read: Callable[[], DataFrame], radius_arcsec: float, order: Sequence[str], refresh: bool = False
) -> StoredCatalog:
    """The stored catalog, written from ``read()`` only if it is not there, was made for another radius or is
    to be refreshed."""
    kept = None if refresh else open_catalog(spark, folder, name)
    if kept is not None and kept.radius_arcsec == radius_arcsec and kept.order == tuple(order):
        return kept
    return store_catalog(read(), folder, name, radius_arcsec, order)
