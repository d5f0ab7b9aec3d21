import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelight.llm import queries, ranker
from tidelight.llm.common import table

LABEL = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    got = queries.op7_quality_ranker(spark, sf)
    rows = got.join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 50
    good = sum(r.predicted == r.quality for r in rows) / len(rows)
    ones = [r.score for r in rows if r.quality == 1]
    zeros = [r.score for r in rows if r.quality == 0]
    auc = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert good > 0.95 and auc > 0.97, (good, auc)
    for r in got.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.3)


def test_held_out_labels_are_not_used(spark, make_docs):
    rows = [(i, f"some words here number {i} " * (1 + i % 4)) for i in range(40)]
    labels = [(i, i % 2, 0) for i in range(40)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    docs = make_docs(rows)
    a, b = (ranker.score(docs, spark.createDataFrame(x, LABEL)).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_cases(spark, make_docs):
    rows = [(1, "Good words in a row."), (2, "BAD!! BAD!! BAD!!"), (3, None), (4, ""), (None, "x"), (1, "Good words in a row."), (6, "é " * 200_000), (7, "b!! " * 9)]
    docs = make_docs(rows, ["f", "score", "y"])
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (3, None, 0), (7, 0, 0), (7, 1, 0), (None, 1, 0), (77, 0, 0)], LABEL)
    got = ranker.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = ranker.score(docs, labels.where(F.lit(False))).collect()
    assert {r.predicted for r in none} == {1} and all(r.score == pytest.approx(0.3) for r in none)
    assert ranker.score(make_docs([]), labels).collect() == []


def test_threshold_covers_all_labelled_rows(spark, make_docs):
    rows = [(i, f"Some words, number {i}. " * (1 + i % 7) + "BAD!! " * (i * i % 11)) for i in range(300)]
    labels = [(i, int(i * i % 11 < 3), 0) for i in range(300)]
    docs, known = make_docs(rows), spark.createDataFrame(labels, LABEL)
    weights, at = ranker.fit(ranker.features(docs), known, max_rows=40)
    used = [(sum(x * w for x, w in zip(ranker.text_features(t), weights)), y) for (i, t), (_, y, _) in zip(rows, labels)
            if zlib.crc32(str(i).encode()) % 5]
    want = np.quantile([s for s, _ in used], sum(1 - y for _, y in used) / len(used))
    assert len(used) > 200 and at == pytest.approx(want, abs=1e-9)
    every = ranker.training_rows(ranker.features(docs), known)
    assert ranker.threshold(every, weights, hot_rows=20) == pytest.approx(want, abs=1e-9)
