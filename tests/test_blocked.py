"""Nearest centres by estimate and exact distance against the plain loop; centres as a table against the plain trainer."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from vecloop.operators.blocked import train_kmeans_blocked
from vecloop.operators.kmeans import _nearest_kernel, nearest_in_block, train_kmeans


def plain(x, centers):
    best, cid = np.full(len(x), np.inf), np.zeros(len(x), np.int32)
    with np.errstate(all="ignore"):
        for i, c in enumerate(centers):
            gap = x - c
            d = np.einsum("ij,ij->i", gap, gap)
            closer = d < best
            best[closer], cid[closer] = d[closer], i
    return cid, best


def kernel(x, centers):
    edges = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    found = list(_nearest_kernel(centers.tolist())(pa.ListArray.from_arrays(edges, pa.array(x.ravel()))))
    return np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])


def planted(n, width, k, seed=0):
    """Points, and centres of which many are equal, some of them to points."""
    rng = np.random.default_rng(seed)
    x, c = rng.random((n, width)), rng.random((k, width))
    c[k // 2 :: 7] = c[1]
    c[-1] = c[0]
    x[:40] = c[rng.integers(0, k, 40)]
    x[40:60] *= 1e4
    return x, c


@pytest.mark.parametrize("n, width, k", [(5000, 3, 1000), (3000, 40, 1000), (2000, 2, 3000), (5000, 4, 10), (1000, 64, 10), (500, 1, 2), (700, 3, 100)])
def test_nearest_equals_the_plain_loop(n, width, k):
    x, c = planted(n, width, k)
    for a, b in zip(kernel(x, c), plain(x, c)):
        assert np.array_equal(a, b)


@pytest.mark.parametrize("scale", [1, 1e-170, 1e150, 1e8])
@pytest.mark.parametrize("k", [12, 1500])
def test_ties_everywhere(scale, k):
    rng = np.random.default_rng(1)
    x, c = rng.integers(0, 3, (2000, 3)) * scale, rng.integers(0, 3, (k, 3)) * scale
    for a, b in zip(kernel(x, c), plain(x, c)):
        assert np.array_equal(a, b)


def test_numbers_out_of_range():
    x = np.array([[0, 0], [np.nan, 1], [np.inf, 0], [1e200, 1e200], [1e-200, 0], [5, 5], [1e154, 0.0]])
    c = np.array([[1e200, 1e200], [0, 0], [0, 0], [np.nan, 0], [np.inf, 1], [1.4e154, 0], [5, 5.000000001]])
    for centers in (c, np.concatenate([c] * 60)):
        for a, b in zip(kernel(x, centers), plain(x, centers)):
            assert np.array_equal(a, b)


@pytest.mark.parametrize("size", [1, 3, 40, 500])
def test_blocks_in_any_order(size):
    x, c = planted(900, 5, 500)
    nearest, blocks = nearest_in_block(), [np.arange(i, min(i + size, 500)) for i in range(0, 500, size)]
    np.random.default_rng(2).shuffle(blocks)
    best, cid = np.full(len(x), np.inf), np.full(len(x), np.iinfo(np.int64).max)
    for ids in blocks:
        nearest(x, c[ids], ids, best, cid)
    assert all(np.array_equal(a, b) for a, b in zip((cid, best), plain(x, c)))


def table(spark, centers):
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centers)], "cid int, c array<double>").repartition(3)


def collected(model):
    rows = sorted((r["iter"], r["cid"], r["c"]) for r in model.history().collect())
    return [[c for i, _, c in rows if i == k] for k in range(model.first_iter, max(i for i, _, _ in rows) + 1)]


@pytest.mark.parametrize("empty", ["keep", "drop"])
@pytest.mark.parametrize("block, held", [(1_000_000, 4_000_000), (12, 100), (1, 1)])
def test_equals_the_plain_trainer(spark, make_points, empty, block, held):
    x, c = planted(300, 4, 12)
    c[5] += 50  # a cluster without points
    points = make_points(x, partitions=3)
    expected = train_kmeans(points, iterations=3, centers=c, empty=empty)
    found = train_kmeans_blocked(points, table(spark, c), 3, empty=empty, block_numbers=block, held_numbers=held)
    for a, b in zip(collected(found), expected.centers, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-12)
    np.testing.assert_allclose(found.costs, expected.costs)
    if empty == "keep":
        np.testing.assert_allclose(found.shifts, expected.shifts)
    else:
        assert found.shifts == expected.shifts == [None] * 3


def test_empty_clusters_can_be_an_error(spark, make_points):
    x, c = planted(60, 4, 5)
    c[2] += 50
    with pytest.raises(PySparkException, match="no new centre for cluster [24]"):
        train_kmeans_blocked(make_points(x), table(spark, c), 1, empty="error")


def test_bad_input(spark, make_points):
    x, c = planted(60, 4, 5)
    points = make_points(x)
    with pytest.raises(ValueError, match="no centres"):
        train_kmeans_blocked(points, table(spark, c).where("false"))
    with pytest.raises(ValueError, match="no points"):
        train_kmeans_blocked(points.where("false"), table(spark, c))
    with pytest.raises(ValueError, match="unequal width"):
        train_kmeans_blocked(points, table(spark, [[1.0], [1.0, 2.0]]))
    with pytest.raises(PySparkException, match="expected a vector of 4"):
        train_kmeans_blocked(points.selectExpr("array(1D) AS x"), table(spark, c))


def test_resumed_from_its_own_table(spark, make_points):
    x, c = planted(200, 4, 9)
    points = make_points(x)
    whole = train_kmeans_blocked(points, table(spark, c), 4)
    again = train_kmeans_blocked(points, whole.centers(2), 2, first_iter=2)
    assert collected(again) == collected(whole)[2:]


def test_points_stay_where_they_are(spark, make_points):
    from vecloop.operators.blocked import sums_by_table

    plan = sums_by_table(make_points([[1.0, 2.0]]), "file:/nowhere", 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(cid") == 1 and "Join" not in plan
