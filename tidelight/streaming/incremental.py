"""Resuming work: skip what is done, refit what is forced, append per batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import by_name
from ..sources.headed import FILE, read_headed


def pending(
    wanted: DataFrame, done: DataFrame, keys: Sequence[str], force: Sequence[str] = (), force_on: str = "source"
) -> DataFrame:
    """Rows of ``wanted`` without a finished counterpart, plus those forced to run again.

    ``done`` may include recorded misses, so that a known empty result is not retried.
    """
    finished = done.select(*keys)
    if force:
        finished = finished.where(~F.col(force_on).isin(list(force)))
    return wanted.join(finished.distinct(), list(keys), "left_anti")


def append_new_files(
    spark: SparkSession,
    in_dir: str,
    schema: StructType,
    work: Callable[[DataFrame], DataFrame],
    out_dir: str,
    checkpoint_dir: str,
    files_per_batch: int = 25,
) -> None:
    """Process the CSV files not seen before and append their results.

    The stream only tells which files are new; their columns are resolved by name for each
    header, cast to ``schema``, NULL where a file lacks one. ``work`` also sees ``file_name``.

    The checkpoint remembers files. Each batch overwrites its own folder, so a batch that is
    repeated after a failure leaves no duplicates. ``checkpoint_dir`` and ``out_dir`` must be
    shared by all executors.
    """
    stream = (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(in_dir).select(F.col("_metadata.file_path").alias("path"))
    )

    def pick(part: DataFrame) -> DataFrame:
        cols = {f.name: by_name(part.columns, [f.name]) for f in schema}
        return part.select(
            *[(F.trim(F.col(f"`{cols[f.name]}`")).try_cast(f.dataType) if cols[f.name] else F.lit(None).cast(f.dataType)).alias(f.name)
              for f in schema], F.col(FILE).alias("file_name"))

    def save(batch: DataFrame, batch_id: int) -> None:
        paths = [r.path for r in batch.select("path").distinct().collect()]  # files_per_batch at most
        if paths:
            work(read_headed(batch.sparkSession, paths, pick)).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
