"""Shared helpers of the text operators: tables, staged results, Arrow kernels."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words.
SPACES = " \t\n\x0b\f\r"


#: Most bytes of a batch that goes to a Python kernel, so that long texts do not add up.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Limit the batches of this session's Python kernels by bytes, where Spark's default holds."""
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)
    if spark.conf.get(name).rstrip("b") == default:
        spark.conf.set(name, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="tidelight-llm-")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here,
    and a lost executor costs nothing that is already written."""
    bounded_batches(df.sparkSession)
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def col(name: str) -> Column:
    """Column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, fn: Callable[[list[list]], Iterator[dict] | dict], schema: str) -> DataFrame:
    """``mapInArrow`` over Python columns. ``fn`` takes a list of column lists of one batch
    and returns a dict of output columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    want = to_arrow_schema(_parse_datatype_string(schema))

    @collector_off
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn([c.to_pylist() for c in batch.columns])
                yield pa.record_batch([_array(out[f.name], f.type) for f in want], schema=want)

    return df.mapInArrow(run, schema)


def collector_off(kernel, keep_values: bool = False):
    """Run a kernel without the cyclic garbage collector, which would walk its large tables of
    words again and again; what it makes has no cycles. Values that a worker keeps for another
    kernel are let go, unless this one uses them."""

    def run(batches):
        import gc
        import sys

        if not keep_values and "_tidelight_worker" in sys.modules:
            sys.modules.pop("_tidelight_worker").__dict__.clear()
        gc.disable()
        try:
            yield from kernel(batches)
        finally:
            gc.enable()

    return run


def worker_value(key, make):
    """A value that a Python worker makes once and keeps for its next tasks."""
    import sys
    import types

    kept = sys.modules.setdefault("_tidelight_worker", types.ModuleType("_tidelight_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def _array(values, kind):
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


#: Rows up to which a counted table is broadcast.
BROADCAST_ROWS = 200_000


def join_counted(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a written table: a broadcast where its counted rows are few, else a plain join,
    whose hot keys adaptive execution splits. The result is the same."""
    return big.join(F.broadcast(small) if small.limit(limit + 1).count() <= limit else small, on, how)


ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)
