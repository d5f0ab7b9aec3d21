"""Headed text tables of mixed layouts: columns are resolved for each distinct header.

The header of a file is its first line that is neither blank nor a comment. One job finds the
distinct headers and their files, then each header gets one scan, whose columns a function picks;
the parts are joined by name. Folders hold few layouts, so there are few scans.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE, PATH, ORDER = "_file", "_path", "_order"


def headers(spark: SparkSession, path: str | Sequence[str], glob: str | None = None, comment: str = "\\") -> list[tuple[str, list[str]]]:
    """(header line, its files) of a folder, files in order of path."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    lines = reader.text(path if isinstance(path, str) else list(path)).select(
        "value", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("i"))
    text = F.trim("value")
    useful = lines.where((text != "") & ~F.startswith(text, F.lit(comment)))
    first = useful.groupBy("p").agg(F.min_by("value", F.struct("b", "i")).alias("h"))
    found = first.groupBy(F.rtrim("h").alias("h")).agg(F.sort_array(F.collect_list("p")).alias("files"))
    return sorted(((r.h, r.files) for r in found.collect()), key=lambda x: x[1][0])


def names_of(header: str, sep: str | None = ",") -> list[str]:
    """Column names of a header line, made distinct; a leading # is no part of a name."""
    parts = [p.strip().strip('"').strip() for p in (header.split(sep) if sep else header.split())]
    out: list[str] = []
    for i, p in enumerate(parts):
        p = p.lstrip("﻿").lstrip("#").strip() if i == 0 else p
        out.append(p if p and p.lower() not in {o.lower() for o in out} else f"{p or 'column'}_{i}")
    return out


def read_headed(
    spark: SparkSession, path: str | Sequence[str], pick: Callable[[DataFrame], DataFrame] | None = None, glob: str | None = None,
    sep: str | None = ",", comment: str = "\\",
) -> DataFrame:
    """Union by name of ``pick(part)`` over the distinct headers; columns that a part lacks are NULL.

    A part has its columns as text, and ``_file``, ``_path``, ``_order`` (its lines' order).
    ``pick`` may return None for a layout that does not fit; it is an error if none fits."""
    found = headers(spark, path, glob, comment)
    out = None
    for header, files in found:
        part = _scan(spark, header, files, sep, comment)
        picked = pick(part) if pick else part
        if picked is not None:
            out = picked if out is None else out.unionByName(picked, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no readable table in {path}: {[h for h, _ in found]}")
    return out


def _scan(spark: SparkSession, header: str, files: list[str], sep: str | None, comment: str) -> DataFrame:
    names = names_of(header, sep)
    extra = [F.col("_metadata.file_name").alias(FILE), F.col("_metadata.file_path").alias(PATH),
             F.struct(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"),
                      F.monotonically_increasing_id().alias("i")).alias(ORDER)]
    if sep:
        schema = ", ".join(f"`{n}` string" for n in names)
        df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("comment", comment).option("sep", sep).csv(files)
        return df.select("*", *extra)
    text = F.trim("value")
    lines = spark.read.text(files).select("value", *extra)
    body = lines.where((text != "") & (F.rtrim("value") != header) & ~F.startswith(text, F.lit(comment)))
    fields = F.split(text, r"\s+")
    return body.select(*[F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(names)], FILE, PATH, ORDER)
