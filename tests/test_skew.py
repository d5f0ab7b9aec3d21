import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelight.operators import skew


@pytest.mark.parametrize("hot", [1000, 5])
def test_quantiles_do_not_depend_on_the_row_limit(spark, hot):
    rng = np.random.default_rng(4)
    groups = {
        "odd": [*map(float, range(20)), float("nan"), float("nan"), float("nan"), float("inf")],
        "equal": [3.5] * 60, "two": [1.0] * 30 + [2.0] * 30, "wide": (10.0 ** rng.uniform(-12, 12, 300)).tolist(),
        "zeros": [0.0] * 200 + rng.normal(size=100).tolist(), "one": [7.0], "nan": [float("nan")], "neg": [-1.0, -2.0, None, -4.0] * 9,
        "infs": [float("-inf")] * 10 + [1.0, 2.0] + [float("inf")] * 10,
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in skew.grouped_quantiles(df, ["g"], "v", probs, hot).collect()}
    for g, vs in groups.items():
        clean = sorted(v for v in vs if v is not None and not np.isnan(v))
        for name, p in probs.items():
            if not clean:
                assert g not in got
                continue
            pos = p * (len(clean) - 1)
            a, b = clean[int(np.floor(pos))], clean[int(np.ceil(pos))]
            want = a if a == b else a + (b - a) * (pos - np.floor(pos))
            assert got[g][name] == pytest.approx(want), (g, name)


def test_join_small_is_the_same_on_either_side_of_the_limits(spark):
    big = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    small = spark.createDataFrame([(i, "x" * 50) for i in range(5)], "k long, v string")
    for how in ("inner", "left"):
        rows = [sorted(map(str, skew.join_small(big, small, ["k"], how, *limits).collect())) for limits in ((), (2,), (100, 10))]
        assert rows[0] == rows[1] == rows[2]
    plans = [skew.join_small(big, small, ["k"], "inner", *limits)._jdf.queryExecution().optimizedPlan().toString() for limits in ((), (100, 10))]
    assert "broadcast" in plans[0] and "broadcast" not in plans[1]
