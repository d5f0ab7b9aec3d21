"""Side-by-side run of a registered query and its SQL counterpart on DuckDB."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb

T: list[float] = []  # seconds of the Spark and of the SQL side
ROOT = os.environ.get("TESTDATA_DIR", "/root/testdata")


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{ROOT}/{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


KIND = {
    "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float",
    "float": "float", "string": "str", "boolean": "bool",
    "BIGINT": "int", "INTEGER": "int", "HUGEINT": "huge", "DOUBLE": "float", "FLOAT": "float",
    "VARCHAR": "str", "BOOLEAN": "bool",
}


def compare(spark, con, fn, sql: str, sf: str) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, f"{ROOT}/{sf}")
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(v) for v in row) for row in df.select(*cols).collect())
    T.append(time.time() - start)
    rel = con.sql(sql)
    want_cols = sorted(rel.columns)
    if cols != want_cols:
        return False, f"columns {cols} vs {want_cols}"
    st = {f.name: f.dataType.simpleString() for f in df.schema}
    dt = dict(zip(rel.columns, map(str, rel.types)))
    bad = [c for c in cols if KIND.get(st[c], st[c]) != KIND.get(dt[c], dt[c])]
    order = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(_norm(r[i]) for i in order) for r in rel.fetchall())
    T.append(time.time() - start - T[0])
    if bad:
        return False, f"types {[(c, st[c], dt[c]) for c in bad]}"
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}"
    diff = [(a, b) for a, b in zip(got, want) if a != b]
    if diff:
        return False, f"{len(diff)}/{len(got)} rows differ, {cols}, first {diff[0]}"
    return True, f"{len(got)} rows"
