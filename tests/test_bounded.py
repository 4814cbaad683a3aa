"""K-means with carried bounds against the plain trainer, and the bounds against all distances."""

import numpy as np
import pytest

from vecloop.operators.bounded import bounded_sums, with_bounds
from vecloop.operators.kmeans import cluster_sums, train_kmeans


def clustered(n, width, k, seed=3):
    """Points around k places, so that most stay with their centre."""
    rng = np.random.default_rng(seed)
    places = rng.random((k, width)) * 20
    return places[rng.integers(0, k, n)] + rng.normal(0, 0.5, (n, width)), places + rng.normal(0, 1, (k, width))


def test_bounds(make_points):
    x, c = clustered(400, 3, 30)
    c[7] = c[2]  # a tie: its points are bounded by their own distance
    x[5] = c[2]
    for r in with_bounds(make_points(x), c.tolist()).collect():
        d = np.sqrt(((np.array(r["x"]) - c) ** 2).sum(1))
        assert r["cid"] == d.argmin() and r["upper"] == pytest.approx(d.min())
        others = np.delete(d, r["cid"]).min()
        assert r["lower"] <= others * (1 + 1e-12) and r["lower"] == pytest.approx(others, abs=1e-5)


@pytest.mark.parametrize("shift", [0, 0.01, 1, 30])
def test_sums_after_a_move(make_points, shift):
    x, c = clustered(500, 4, 25)
    points, to = make_points(x), c + np.random.default_rng(1).normal(0, 1, c.shape) * shift
    found = {r["cid"]: r for r in bounded_sums(with_bounds(points, c.tolist()), c.tolist(), to.tolist()).collect()}
    expected = {r["cid"]: r for r in cluster_sums(points, to.tolist()).collect()}
    assert {i for i, r in found.items() if r["n"]} == set(expected)
    for i, r in expected.items():
        assert found[i]["n"] == r["n"] and found[i]["cost"] == pytest.approx(r["cost"])
        np.testing.assert_allclose(found[i]["g"], r["g"])
    skipped = sum(r["skipped"] for r in found.values()) / 500
    assert skipped > 0.9 if shift <= 0.01 else skipped < 0.9


@pytest.mark.parametrize("empty", ["keep", "drop"])
def test_equals_the_plain_trainer(make_points, empty):
    x, c = clustered(800, 4, 40)
    c[11] = c[3]
    c[20] += 500
    plain = train_kmeans(make_points(x), iterations=8, centers=c, empty=empty)
    bounded = train_kmeans(make_points(x), iterations=8, centers=c, empty=empty, bounds=True)
    for a, b in zip(plain.centers, bounded.centers, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-12)
    np.testing.assert_allclose(plain.costs, bounded.costs)
    assert len(bounded.skipped) == 8 and max(bounded.skipped[1:]) > 0.5


def test_ties_and_distant_points(make_points):
    rng = np.random.default_rng(0)
    x, c = rng.integers(0, 3, (300, 2)).astype(float), rng.integers(0, 3, (12, 2)).astype(float)
    x[0] = [1e100, 1]
    x[1] = [1e-200, 0]
    plain = train_kmeans(make_points(x), iterations=4, centers=c)
    bounded = train_kmeans(make_points(x), iterations=4, centers=c, bounds=True)
    for a, b in zip(plain.centers, bounded.centers, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-12)
    one = train_kmeans(make_points(x[1:]), iterations=2, centers=[[0.0, 0.0]], bounds=True)
    np.testing.assert_allclose(one.final, [x[1:].mean(0)])


def test_bounds_need_the_cache(make_points):
    with pytest.raises(ValueError, match="bounds are kept"):
        train_kmeans(make_points([[1.0]]), 1, 1, bounds=True, cache=False)
    with pytest.raises(ValueError, match="no points"):
        train_kmeans(make_points([[1.0]]).where("false"), 1, 1, [[1.0]], bounds=True)


def test_nothing_stays_in_memory(spark, make_points):
    x, c = clustered(100, 2, 5)
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    train_kmeans(make_points(x), iterations=6, centers=c, bounds=True)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
