import numpy as np
import pandas as pd
import pytest

from tidelight.operators import sky
from tidelight.plans import sky_queries

AS = 1 / 3600.0


def sep(ra1, de1, ra2, de2):
    a, b, c, d = map(np.radians, (ra1, de1, ra2, de2))
    h = np.sin((d - b) / 2) ** 2 + np.cos(b) * np.cos(d) * np.sin((c - a) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.sqrt(h))) * 3600


def frame(spark, ra, dec, **cols):
    return spark.createDataFrame(pd.DataFrame({"ra": ra, "dec": dec, **cols}))


def test_wrap_and_poles(spark):
    pts = frame(spark, [359.999, 10.0, 190.0], [0.0, 89.9999, -89.9999], src=[1, 2, 3])
    cat = frame(spark, [0.001, 190.0, 10.0, 180.0], [0.0, 89.9999, -89.9999, 0.0], row_idx=[1, 2, 3, 4])
    got = {r.src: (r.m_row_idx, round(r.sep, 3)) for r in sky.cone_join(pts, cat, 10.0, ["row_idx"]).collect()}
    assert got == {1: (1, 7.2), 2: (2, 0.72), 3: (3, 0.72)}


@pytest.mark.parametrize("spread", [1.0, 8.0, 60.0])
def test_crowded_cone_matches_brute_force(spark, spread):
    rng = np.random.default_rng(int(spread))
    p = rng.normal(0, spread, (150, 2)) * AS + [40.0, 60.0]
    c = rng.normal(0, spread, (200, 2)) * AS + [40.0, 60.0]
    c[50:60] = c[0]
    pts, cat = frame(spark, p[:, 0], p[:, 1], src=range(150)), frame(spark, c[:, 0], c[:, 1], row_idx=range(200), v=rng.uniform(0, 1, 200))
    got = {r.src: r.m_row_idx for r in sky.cone_join(pts, cat, 10.0, ["row_idx"]).collect()}
    d = sep(p[:, None, 0], p[:, None, 1], c[None, :, 0], c[None, :, 1])
    want = {i: int(np.argmin(d[i])) if d[i].min() <= 10 else None for i in range(150)}
    assert got == want
    agg = {(r.ra, r.dec): r.n_in_cone for r in sky.cone_aggregate(pts, cat, 10.0, "v").collect()}
    near = (d <= 10).sum(1)
    assert agg == {(p[i, 0], p[i, 1]): near[i] for i in range(150) if near[i]}


def shuffled(df):
    """Rows that the shuffles of a plan wrote."""
    df.collect()

    def walk(node):
        kind, inner = node.getClass().getSimpleName(), None
        if kind == "ReusedExchangeExec":
            return 0
        if kind == "AdaptiveSparkPlanExec":
            inner = node.executedPlan()
        elif kind.endswith("QueryStageExec"):
            inner = node.plan()
        own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        children = node.children()
        below = [inner] if inner is not None else [children.apply(i) for i in range(children.size())]
        return own + sum(walk(x) for x in below)

    return walk(df._jdf.queryExecution().executedPlan())


def test_aggregate_shuffles_a_catalog_row_once(spark):
    rng = np.random.default_rng(5)
    ra, dec = rng.uniform(0, 360, 200), rng.uniform(-80, 80, 200)
    k, step = np.repeat(np.arange(200), 40), np.tile(np.arange(40), 200)
    pts = frame(spark, ra, dec, row_idx=range(200))
    cat = frame(spark, ra[k], dec[k] + step * 0.21 * AS, flux=rng.uniform(0, 1, len(k)), archive=np.array(list("ANR"))[step % 3])
    agg = sky.cone_aggregate(pts, cat, 5.0, "flux", by=["archive"])
    assert shuffled(agg) < 1.6 * len(k)
    want = (sep(ra[k], dec[k], ra[k], dec[k] + step * 0.21 * AS) <= 5.0).sum()
    assert sum(r.n_in_cone for r in agg.collect()) == want


@pytest.mark.parametrize("crowd", [0, 5, 256])
@pytest.mark.parametrize("at", [(40.0, 60.0), (0.0, 0.0), (120.0, 89.9995)])
def test_aggregate_by_pairs_and_by_sub_cells_is_the_same(spark, crowd, at):
    rng = np.random.default_rng(8)
    p, c = rng.normal(0, 9.0, (80, 2)) * AS, rng.normal(0, 9.0, (300, 2)) * AS
    p[40:], c[150:200] = p[40:] * 20, c[0]  # half of the points apart, copies of a row
    p, c = p + at, c + at
    p[:, 0], c[:, 0] = p[:, 0] % 360, c[:, 0] % 360
    kind, v = rng.choice(["x", "y", None], 300), rng.uniform(0, 1, 300)
    pts = frame(spark, [*p[:, 0], *p[:5, 0], None], [*p[:, 1], *p[:5, 1], 1.0])
    cat = spark.createDataFrame([(*map(float, x), k, float(y) if i % 7 else None) for i, (x, k, y) in enumerate(zip(c, kind, v))], "ra double, dec double, kind string, v double")
    got = {(r.ra, r.dec, r.kind): (r.n_in_cone, r.max_value) for r in sky.cone_aggregate(pts, cat, 5.0, "v", by=["kind"], crowd=crowd).collect()}
    near = sep(p[:, None, 0], p[:, None, 1], c[None, :, 0], c[None, :, 1]) <= 5
    want = {}
    for i in range(len(p)):
        for k in ("x", "y", None):
            met = [j for j in np.flatnonzero(near[i]) if kind[j] == k]
            if met:
                want[p[i, 0], p[i, 1], k] = (len(met), max((v[j] for j in met if j % 7), default=None))
    assert len(want) > 40 and got == want


def greedy(ra, dec, cat, radius):
    used, out = np.zeros(len(ra), bool), {}
    for i in range(len(ra)):
        if not used[i]:
            close = sep(ra[i], dec[i], ra, dec) < radius
            used |= close
            out[i] = ("|".join(pd.unique(np.asarray(cat)[close])), int(close.sum()))
    return out


@pytest.mark.parametrize("seed,spread", [(1, 4.0), (2, 15.0), (3, 60.0)])
def test_greedy_dedup_matches_brute_force(spark, seed, spread):
    rng = np.random.default_rng(seed)
    n = 160
    xy = rng.normal(0, spread, (n, 2)) * AS + [200.0, -30.0]
    xy[100:120] = xy[3]  # exact copies
    cat = rng.choice(["A", "B", "C"], n)
    df = frame(spark, xy[:, 0], xy[:, 1], ord=range(n), cat=cat)
    got = {r.ord: (r.labels, r.n_close) for r in sky.greedy_dedup(df, 5.0, "ord", "cat").collect()}
    assert got == greedy(xy[:, 0], xy[:, 1], cat, 5.0)


def test_dedup_is_not_transitive(spark):
    df = frame(spark, [10.0] * 3, [0.0, 4 * AS, 8 * AS], ord=[0, 1, 2], cat=["x", "y", "z"])
    got = {r.ord: r.labels for r in sky.greedy_dedup(df, 5.0, "ord", "cat").collect()}
    assert got == {0: "x|y", 2: "y|z"}


@pytest.mark.parametrize("name", ["cone_nearest", "cone_best_catalog", "cone_archives", "classify_sources", "class_summary"])
def test_cone_joins_collect_no_side_on_the_driver(spark, name):
    # the files are small, what is exploded or folded from them need not be
    plan = sky_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_neighbours_are_cells_on_the_sphere(spark):
    rng = np.random.default_rng(3)
    ra, dec = rng.uniform(0, 360, 300), np.degrees(np.arcsin(rng.uniform(-1, 1, 300)))
    dec[:4] = [90.0, -90.0, 0.0, 0.0]
    cells = sky.with_cell(frame(spark, ra, dec), 600.0)
    around = sky.with_neighbours(cells, 600.0)
    n = around.count()
    assert 300 < n < 300 * 18
    near = sky.with_cell(frame(spark, ra + 0.1, np.clip(dec + 0.1, -90, 90)), 600.0).select(*sky.CELL).collect()
    own = {tuple(r) for r in around.select(*sky.CELL).collect()}
    assert {tuple(r) for r in cells.select(*sky.CELL).collect()} <= own
    assert sum(tuple(r) in own for r in near) >= 295
