"""Tables of fixed columns whose edges are the pipes of the header lines.

    \\ comment or keyword
    |   ra    |  name      |
    |  double |  char      |
    |   deg   |            |
    |  null   |  --        |
       10.5      Crab  PSR

Up to four lines that start with a pipe give names, types, units and null marks. A value stands between two
pipes, so blanks inside it are kept. Files of equal header lines share one scan, and the parts are
joined by name; all of it is column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import no_nan

FILE = "_file"
# ---- Fixed values: names of types, which may be cut short ----
TYPES = {"double": "double", "float": "double", "real": "double", "long": "bigint", "integer": "bigint", "char": "string", "date": "string"}
# ------------------------------------------------------------


def layouts(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> list[tuple[list[str], list[str]]]:
    """(header lines, files) of each distinct layout, in order of path."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    lines = reader.text(path if isinstance(path, str) else list(path)).select(
        F.rtrim("value").alias("value"), F.col("_metadata.file_path").alias("p"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"))
    piped = lines.where(F.startswith("value", F.lit("|")))
    first = piped.groupBy("p").agg(F.min("at").alias("first"))
    near = (F.col("at.b") == F.col("first.b")) & (F.col("at.i") < F.col("first.i") + 4)  # header lines stand together
    heads = piped.join(first, "p").where(near).groupBy("p").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("h"))
    found = heads.groupBy(F.col("h.value").alias("h")).agg(F.sort_array(F.collect_list("p")).alias("files")).collect()
    return sorted(((list(r.h), list(r.files)) for r in found), key=lambda x: x[1][0])


def fields(header: Sequence[str]) -> list[tuple[str, int, int, str, str]]:
    """(name, start, length, type, null mark) of each column; starts count from 1, the pipe of the left edge is
    part of a column."""
    bars = [i for i, ch in enumerate(header[0]) if ch == "|"]

    def cell(line: int, a: int, b: int) -> str:
        return header[line][a + 1 : b].strip() if len(header) > line else ""

    out = []
    for i, (a, b) in enumerate(zip(bars, bars[1:])):
        name = cell(0, a, b) or f"column_{i}"
        if name.lower() in {o[0].lower() for o in out}:
            name = f"{name}_{i}"
        kind = re.sub(r"[^a-z].*", "", cell(1, a, b).lower())
        known = next((t for k, t in TYPES.items() if kind and k.startswith(kind)), "string")
        out.append((name, a + 1, b - a, known, cell(3, a, b)))
    return out


def _value(start: int, length: int, kind: str, null: str) -> Column:
    text = F.trim(F.substring("value", start, length))
    text = F.when((text != "") & (text != F.lit(null)), text)
    return no_nan(text.try_cast("double")) if kind == "double" else text.try_cast(kind) if kind != "string" else text


def read_pipe_header(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Union by name of the tables of a file or folder, and ``_file``; columns that a file lacks are NULL."""
    out = None
    for header, files in layouts(spark, path, glob):
        lines = spark.read.text(files)
        body = lines.where((F.trim("value") != "") & ~F.substring("value", 1, 1).isin("|", "\\"))
        part = body.select(*[_value(s, n, k, null).alias(name) for name, s, n, k, null in fields(header)], F.col("_metadata.file_name").alias(FILE))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no header line that starts with a pipe in {path}")
    return out
