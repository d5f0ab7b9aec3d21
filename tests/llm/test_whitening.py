"""Whitening against numpy's eigensolver."""

import math

import numpy as np
import pytest

from tidelight.llm import whitening


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(vectors, k=32):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(1), c @ u / np.sqrt(e), e / e.sum() if k >= x.shape[1] else e / np.trace(c.T @ c / n)


@pytest.mark.parametrize("d", [1, 2, 3, 17, 60])
def test_components_of_a_matrix(d):
    a = np.random.default_rng(d).normal(size=(d, d))
    a = a @ a.T
    values, vectors = whitening.leading_components(a, 9)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:9], rtol=1e-12, atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-11)


def test_equal_eigenvalues_stay_orthogonal():
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(12, 12)))
    a = q @ np.diag([5, 5, 5, 3, 3 + 1e-13, 1, 1, 1, 1, 0, 0, 0.0]) @ q.T
    for m in (a, np.eye(6), np.zeros((4, 4))):
        values, vectors = whitening.leading_components((m + m.T) / 2, 12)
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
        assert np.allclose(m @ vectors, vectors * values, atol=1e-12)


def test_query_against_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 40)) @ np.diag(np.linspace(0.1, 2, 40))
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(vectors)]
    got = whitening.per_component(whitening.whiten(frame(spark, rows).repartition(5))).toPandas()
    dev, white, explained = brute(vectors)
    assert len(got) == 300 * 32 and set(got.n) == {300}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert np.allclose(wide * np.sign((wide * white).sum(0)), white, atol=1e-9)
    first = got[got.component == 1].sort_values("vec_id")
    assert first.deviation.tolist() == dev.tolist()
    assert np.allclose(got[got.vec_id == 0].sort_values("component").explained, explained, rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-12


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [1.5, 0.0], 0), (2, [1.5, 0.0], 0), (None, [0.0, 4.0], 0), (5, None, 0), (6, [], 0),
            (7, [1.0, None], 0), (8, [math.nan, 1.0], 0), (9, [math.inf, 1.0], 0), (10, [1.0, 2.0, 3.0], 0), (11, [3e38, 1.0], 0)]
    got = whitening.whiten(frame(spark, rows).withColumnRenamed("label", "whitened")).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "11", "2", "2", "None"]
    assert all(r.n == 5 and len(r.whitened) == len(r.explained) for r in got)
    wide = whitening.per_component(whitening.whiten(frame(spark, rows[:4]))).collect()
    assert len(wide) == 8 and all(r.deviation is not None for r in wide)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, None, 0)]])
def test_without_spread_no_rows(spark, rows):
    out = whitening.per_component(whitening.whiten(frame(spark, rows)))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.count() == 0


def test_fewer_rows_than_dimensions(spark):
    rng = np.random.default_rng(5)
    got = whitening.whiten(frame(spark, [(i, [float(c) for c in rng.normal(size=30)], 0) for i in range(6)])).collect()
    assert {len(r.whitened) for r in got} == {5} and got[0].identity_error < 1e-6
