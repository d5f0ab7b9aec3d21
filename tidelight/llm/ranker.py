"""Quality scores learned from preference pairs (Bradley-Terry).

A document's strength is linear in its features; that a document of label 1 beats one of label 0
is a logistic loss on the difference of their features, without an intercept. Features are
shares and logarithms of counts in the text alone (letters, cases, marks, repeats, lines), never
labels, language, source or id. The threshold is an exact quantile of the strengths of all
labelled rows that are not held out, at the share of label 0 among them; scores are shifted so
that it scores ``cut``.

Features of all documents are computed in one pass and written; labels join those. The fit uses
at most ``max_rows`` labelled rows, those of the lowest hash of id, each paired with
``pairs`` rows of the other label; it runs as a Spark ML job. Only the fit is bounded so: class
share and threshold come from all labelled rows, at any size; the quantile of many rows is found
by narrowing a bracket. All rows are scored by column arithmetic on their features.

Defined cases: a null or empty text has features of 0 and a score; rows without a label, with a
null one or with conflicting ones do not train; without both labels in the fit all strengths are 0 and all
scores ``cut``; equal ids and repeated rows each get their row; a null id is not held out;
empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import grouped_quantiles
from .common import arrow_map, col, stage

MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
N_FEATURES = 16 + len(MARKS)
#: Rows up to which one task finds the quantile of all strengths.
QUANTILE_ROWS = 50_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_features(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * N_FEATURES
    b = np.frombuffer(raw, np.uint8)
    c = np.bincount(b, minlength=256)
    n, size = len(words), len(b)
    upper, lower, high = int(c[65:91].sum()), int(c[97:123].sum()), int(c[128:].sum())
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    space = np.append(_SPACE[b], True)
    last = np.bincount(b[space[1:] & ~space[:-1]], minlength=256)
    root = math.sqrt
    out = [
        math.log1p(n), math.log1p(size), (size - int(_SPACE[b].sum())) / n, len(counts) / n, root(max(counts.values()) / n),
        root(sum(map(eq, words, words[1:])) / n), root(upper / max(upper + lower, 1)), root(int(c[48:58].sum()) / size),
        root(high / size), root(int(c[10]) / size), math.log1p(n / len(lines)), root(1 - len(set(lines)) / len(lines)),
        root((int(last[65:91].sum()) + int(last[97:123].sum()) + int(last[128:].sum())) / n), root(int(last[46]) / n),
        root(int(last[44]) / n), root(int(last[33]) / n),
    ]
    return out + [root(int(c[m]) / size) for m in MARKS]


def features(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    rows = docs.select(col(id_col), col(text_col))
    made = arrow_map(rows, lambda c: {"doc_id": c[0], "f": [text_features(t) for t in c[1]]}, "doc_id long, f array<double>")
    return stage(made)


def training_rows(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """f, y, h of all labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").alias("k"), F.col("quality").alias("y")).where("k IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top")
    rows = feats.where(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("k"))
    return rows.select("f", "y", F.xxhash64("doc_id", "f").alias("h"))


def held_out(key):
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(feats: DataFrame, labels: DataFrame, max_rows: int = 20_000, pairs: int = 4) -> tuple[list[float], float]:
    """Weights on raw features and the strength at the threshold."""
    every = stage(training_rows(feats, labels))
    rows = stage(every.orderBy("h").limit(max_rows))
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        return [0.0] * N_FEATURES, 0.0
    at = [F.stddev_pop(F.col("f")[i]).alias(f"s{i}") for i in range(N_FEATURES)]
    scale = [s if s and s > 1e-9 else 0.0 for s in rows.agg(*at).first()]
    # windows over the bounded sample
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h", "f")) - 1)
    good = ranked.where("y = 1").select(F.col("f").alias("a"), F.col("r").alias("ra"))
    bad = ranked.where("y = 0").select(F.col("f").alias("b"), F.col("r").alias("rb"))
    n_good, n_bad = counts[1], counts[0]
    # every row of the larger class meets ``pairs`` rows of the other, by a stride over its ranks
    big, small, rank, other, n = (good, bad, "ra", "rb", n_bad) if n_good >= n_bad else (bad, good, "rb", "ra", n_good)
    met = big.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))))
    met = met.withColumn(other, ((F.col(rank) * pairs + F.col("j")) % n).cast("int")).join(small, other)
    side = F.when((F.col("ra") + F.col("rb") + F.col("j")) % 2 == 0, 1.0).otherwise(-1.0)
    diff = F.array(*[(F.col("a")[i] - F.col("b")[i]) * (side / F.lit(s)) if s else F.lit(0.0) for i, s in enumerate(scale)])
    flip = F.when(side > 0, 1.0).otherwise(0.0)
    train = stage(met.select(array_to_vector(diff).alias("features"), flip.alias("label")))
    model = LogisticRegression(fitIntercept=False, standardization=False, regParam=1e-4, maxIter=60).fit(train)
    weights = [float(w) / s if s else 0.0 for w, s in zip(model.coefficients.toArray(), scale)]
    return weights, threshold(every, weights)


def threshold(rows: DataFrame, weights: list[float], hot_rows: int = QUANTILE_ROWS) -> float:
    """The quantile of all strengths at the share of label 0; above ``hot_rows`` rows by narrowing."""
    values = stage(rows.select(F.lit(0).alias("k"), "y", strength(F.col("f"), weights).alias("v")))
    share = values.agg(F.avg(1 - F.col("y"))).first()[0]
    return grouped_quantiles(values, ["k"], "v", {"at": share}, hot_rows).first().at


def strength(f, weights):
    return sum((f[i] * F.lit(w) for i, w in enumerate(weights) if w), F.lit(0.0))


def score(docs: DataFrame, labels: DataFrame, cut: float = 0.3, max_rows: int = 20_000, pairs: int = 4, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    feats = features(docs, id_col, text_col)
    weights, at = fit(feats, labels, max_rows, pairs)
    shifted = strength(F.col("f"), weights) - F.lit(at) + F.lit(math.log(cut / (1 - cut)))
    value = 1 / (1 + F.exp(-shifted))
    return feats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score")).withColumn(
        "predicted", (F.col("score") >= cut).cast("int"))
