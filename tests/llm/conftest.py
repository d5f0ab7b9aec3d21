import os

import pytest
from pyspark.sql import types as T

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")
DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def small():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, source]) tuples; ``more`` adds clashing columns."""

    def make(rows, more=()):
        schema = T.StructType([*DOC.fields, *[T.StructField(c, T.StringType()) for c in more]])
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", len(r[1] or "")) + ("x",) * len(more) for r in rows]
        return spark.createDataFrame(full, schema)

    return make
