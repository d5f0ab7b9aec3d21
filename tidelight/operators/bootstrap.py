"""Empirical false-alarm probability from moving-block resampling.

Python only draws the random blocks (the generator must be NumPy's to reproduce results);
the null curves then run through the same detection plan as the data, with the draw
number as one more series key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DetectorConfig
from .detect import detect_events
from .skew import spread


def null_values(
    val: np.ndarray, base: np.ndarray, quiet: np.ndarray, cfg: DetectorConfig
) -> np.ndarray | None:
    """(draws, n) null curves of one time-ordered series, None if too few quiet rows."""
    resid = (val - base)[quiet]
    if resid.size < cfg.bootstrap_min_quiescent:
        return None
    length = min(cfg.block_length, resid.size)
    pieces = -(-len(val) // length)
    rng = np.random.default_rng(cfg.bootstrap_seed)
    starts = rng.integers(0, resid.size - length + 1, size=cfg.n_bootstrap * pieces)
    at = (starts[:, None] + np.arange(length)).reshape(cfg.n_bootstrap, -1)[:, : len(val)]
    return base + resid[at]


def null_series(based: DataFrame, keys: Sequence[str], cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Null curves of every series: keys, draw, mjd, val, err, base, sigma.

    A rebinned series, bounded by its time span, travels as one row of arrays, so that the
    draws are dealt evenly over the tasks.
    """
    keys = list(keys)
    point = ["mjd", "val", "err", "base", "sigma", "quiet"]
    rows = based.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*point))).alias("_p"))
    rows = rows.select(*keys, *[F.col(f"_p.{c}").alias(c) for c in point])
    out = T.StructType(
        [based.schema[k] for k in keys]
        + [T.StructField(c, T.DoubleType()) for c in point[:-1]]
        + [T.StructField("draw", T.IntegerType())]
    )

    def draw(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                base = np.asarray(row.base, float)
                nulls = null_values(np.asarray(row.val, float), base, np.asarray(row.quiet, bool), cfg)
                if nulls is None:
                    continue
                n = len(base)
                rep = {k: np.repeat(np.asarray([getattr(row, k)]), nulls.size) for k in keys}
                rep |= {c: np.tile(np.asarray(getattr(row, c), float), cfg.n_bootstrap) for c in point[:-1]}
                rep["val"] = nulls.ravel()
                rep["draw"] = np.repeat(np.arange(cfg.n_bootstrap, dtype="int32"), n)
                yield pd.DataFrame(rep)

    return spread(rows).mapInPandas(draw, out)


def false_alarm(
    events: DataFrame, based: DataFrame, keys: Sequence[str], cfg: DetectorConfig = DetectorConfig()
) -> DataFrame:
    """``events`` with fap_empirical: share of draws whose strongest null event is at least
    as significant (NULL where a series has too few quiet rows). Only series with events
    are resampled."""
    keys = list(keys)
    chosen = based.join(events.select(*keys).distinct(), keys, "left_semi")
    nulls = detect_events(null_series(chosen, keys, cfg), [*keys, "draw"], cfg)
    peak = nulls.groupBy(*keys, "draw").agg(F.max("significance_sigma").alias("_m"))
    maxima = peak.groupBy(*keys).agg(F.collect_list("_m").alias("_maxima"))
    able = chosen.groupBy(*keys).agg(
        (F.count_if("quiet") >= cfg.bootstrap_min_quiescent).alias("_able")
    )
    df = events.join(able, keys, "left").join(maxima, keys, "left")
    # draws without any null event count as significance 0, below every event
    hits = F.size(
        F.filter(F.coalesce("_maxima", F.array().cast("array<double>")), lambda m: m >= F.col("significance_sigma"))
    )
    fap = F.when(F.col("_able"), hits / F.lit(float(cfg.n_bootstrap)))
    return df.withColumn("fap_empirical", fap).drop("_able", "_maxima")
