import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vecloop.operators import kmeans, model
from vecloop.operators.centers import center_shift, join_centers, upsert_centers
from vecloop.operators.kmeans import assign, cluster_means, cluster_sums, distances, train_kmeans
from vecloop.operators.sampling import sample_k, sample_vectors


def closest(point, centers):
    best, index = float("inf"), 0
    for i, c in enumerate(centers):
        d = float(((point - c) ** 2).sum())
        if d < best:
            best, index = d, i
    return index


def loop(x, centers, iterations, empty="keep"):
    """The trainer, written plainly."""
    history = [np.array(centers, float)]
    for _ in range(iterations):
        old = history[-1]
        ids = np.array([closest(p, old) for p in x])
        new = [x[ids == i].mean(axis=0) if (ids == i).any() else None for i in range(len(old))]
        if empty == "drop":
            history.append(np.array([c for c in new if c is not None]))
        else:
            history.append(np.array([o if c is None else c for o, c in zip(old, new)]))
    return history


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(11).random((300, 6))


def same(a, b):
    assert len(a) == len(b)
    for u, v in zip(a, b):
        np.testing.assert_allclose(u, v, rtol=1e-9)


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_equals_plain_loop(make_points, x, partitions):
    trained = train_kmeans(make_points(x, partitions=partitions), iterations=6, centers=x[:7])
    same(trained.centers, loop(x, x[:7], 6))
    shifts = [((a - b) ** 2).sum() for a, b in zip(map(np.array, trained.centers), map(np.array, trained.centers[1:]))]
    np.testing.assert_allclose(trained.shifts, shifts, rtol=1e-9)


def test_cost_never_rises(make_points, x):
    costs = train_kmeans(make_points(x), iterations=8, centers=x[:5]).costs
    assert all(later <= earlier + 1e-9 for earlier, later in zip(costs, costs[1:]))


def test_uncached(make_points, x):
    points = make_points(x)
    same(
        train_kmeans(points, iterations=3, centers=x[:4]).centers,
        train_kmeans(points, iterations=3, centers=x[:4], cache=False).centers,
    )


def test_tie_takes_the_lowest_index(make_points):
    points = make_points([[0.0], [2.0], [1.0]])
    centers = [[0.0], [2.0], [2.0]]
    rows = {r["id"]: r["cid"] for r in assign(points, centers).collect()}
    assert rows == {0: 0, 1: 1, 2: 0}
    sums = {r["cid"]: (r["n"], r["g"]) for r in cluster_sums(points, centers).collect()}
    assert sums == {0: (2, [1.0]), 1: (1, [2.0])}


def test_sums_agree_with_assignment(make_points, x):
    points, centers = make_points(x), x[:8]
    by_row = assign(points, centers.tolist()).groupBy("cid").agg(F.count("*").alias("n"), F.sum(F.get("x", F.lit(2))).alias("s"))
    expected = {r["cid"]: (r["n"], pytest.approx(r["s"])) for r in by_row.collect()}
    assert {r["cid"]: (r["n"], r["g"][2]) for r in cluster_sums(points, centers.tolist()).collect()} == expected
    means = {r["cid"]: r["c"][2] for r in cluster_means(points, centers.tolist()).collect()}
    assert means == {cid: pytest.approx(s.expected / n) for cid, (n, s) in expected.items()}


@pytest.mark.parametrize("fan_in", [0, 3, 4])
def test_two_step_merge(make_points, x, fan_in):
    trained = train_kmeans(make_points(x, partitions=9), iterations=3, centers=x[:5], fan_in=fan_in)
    same(trained.centers, loop(x, x[:5], 3))


def _layouts(monkeypatch):
    """Rows per partition as each iteration sees them, and whether its plan shuffles points."""
    seen, sums = [], kmeans._sums_prepared

    def watched(data, *rest):
        rows = data.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        plan = data._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        seen.append((sorted(r["count"] for r in rows), "Exchange" in plan))
        return sums(data, *rest)

    monkeypatch.setattr(kmeans, "_sums_prepared", watched)
    return seen


def test_points_are_laid_out_once(spark, make_points, x, monkeypatch):
    seen = _layouts(monkeypatch)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    trained = train_kmeans(make_points(x, partitions=1), iterations=4, centers=x[:5], partitions=4)
    same(trained.centers, loop(x, x[:5], 4))
    assert seen == [([75] * 4, False)] * 4
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_points_stay_as_they_are_read(make_points, x, monkeypatch):
    seen = _layouts(monkeypatch)
    points = make_points(x[:60], partitions=6).union(make_points(x[60:], partitions=1))
    train_kmeans(points, iterations=3, centers=x[:5])
    assert seen[0] == seen[1] == seen[2]
    assert len(seen[0][0]) == 7 and seen[0][0][-1] == 240 and not seen[0][1]


def test_resumed(make_points, x):
    whole = train_kmeans(make_points(x), iterations=5, centers=x[:4])
    rest = train_kmeans(make_points(x), iterations=3, centers=whole.centers[2], first_iter=2)
    assert rest.centers == whole.centers[2:]
    assert [r["iter"] for r in rest.shift_history().collect()] == [3, 4, 5]
    assert {r["iter"] for r in rest.history().collect()} == {2, 3, 4, 5}


def test_vectors_are_drawn_alike_however_they_lie(spark, make_points, x):
    doubled = np.concatenate([x, x[:50], x[:50]])
    draws = [[r["x"] for r in sample_vectors(make_points(doubled, partitions=p), 10).collect()] for p in (1, 4, 16)]
    assert draws[0] == draws[1] == draws[2] and len({tuple(v) for v in draws[0]}) == 10
    assert {tuple(v) for v in draws[0]} <= {tuple(v) for v in x.tolist()}
    assert sample_vectors(make_points(x[:7]), 10).count() == 7
    assert sample_vectors(make_points(x).where("false"), 3).count() == 0
    started = train_kmeans(make_points(doubled).select("x"), 10, 1, id_col=None)
    assert started.centers[0] == draws[0]


def test_floats_are_taken_as_doubles(spark, x):
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    points = spark.createDataFrame(rows, "id bigint, x array<float>")
    data = x.astype(np.float32).astype(float)
    same(train_kmeans(points, iterations=3, centers=data[:4]).centers, loop(data, data[:4], 3))


@pytest.mark.parametrize("fan_in", [0, 2])
def test_very_wide_vectors(make_points, fan_in):
    data = np.random.default_rng(4).random((40, 150))
    trained = train_kmeans(make_points(data, partitions=5), iterations=3, centers=data[:4], fan_in=fan_in)
    same(trained.centers, loop(data, data[:4], 3))
    assert all(later <= earlier + 1e-9 for earlier, later in zip(trained.costs, trained.costs[1:]))


def test_one_cluster_holds_almost_everything(make_points, x):
    data = np.vstack([np.zeros((500, 6)), x])
    centers = np.vstack([np.zeros((1, 6)), x[:3]])
    same(train_kmeans(make_points(data), iterations=3, centers=centers).centers, loop(data, centers, 3))


def test_empty_clusters(make_points, x):
    centers = np.array([[float(i)] * 6 for i in range(5)])
    points = make_points(x)
    same(train_kmeans(points, iterations=4, centers=centers).centers, loop(x, centers, 4))
    dropped = train_kmeans(points, 5, 4, init="diagonal", empty="drop")
    same(dropped.centers, loop(x, centers, 4, "drop"))
    assert [len(c) for c in dropped.centers] == [5, 2, 2, 2, 2]
    with pytest.raises(ValueError, match="without points: \\[2, 3, 4\\]"):
        train_kmeans(points, iterations=1, centers=centers, empty="error")


def test_duplicate_start_is_an_empty_cluster(make_points, x):
    centers = np.vstack([x[:2], x[:1]])
    trained = train_kmeans(make_points(x), iterations=1, centers=centers)
    assert trained.final[2] == x[0].tolist()


def test_sample(make_points, x):
    draws = [[r["id"] for r in sample_k(make_points(x, partitions=p), 10, "id").collect()] for p in (1, 4, 16)]
    assert draws[0] == draws[1] == draws[2] and len(set(draws[0])) == 10
    assert draws[0] != [r["id"] for r in sample_k(make_points(x), 10, "id", seed=1).collect()]
    trained = train_kmeans(make_points(x), 10, 1)
    assert trained.centers[0] == [x[i].tolist() for i in draws[0]]


def test_more_centers_than_points(make_points, x):
    with pytest.raises(ValueError, match="only 3 points"):
        train_kmeans(make_points(x[:3]), 4, 1)


def test_other_width_and_no_points(spark, make_points, x):
    with pytest.raises(PySparkException, match="expected a vector"):
        train_kmeans(make_points(x), iterations=1, centers=[[1.0, 2.0]])
    empty = spark.createDataFrame([], "id bigint, x array<double>")
    for options in ({"centers": [[1.0]]}, {"init": "diagonal"}, {}):
        with pytest.raises(ValueError, match="no points"):
            train_kmeans(empty, 2, 1, **options)


def test_model_size_is_checked(make_points, x):
    with pytest.raises(ValueError, match="max_model_numbers"):
        train_kmeans(make_points(x), iterations=1, centers=x[:5], max_model_numbers=10)


def test_large_model_value(make_points, x, monkeypatch):
    points = make_points(x)
    expected = sorted(distances(points, x[:9].tolist()).collect())
    monkeypatch.setattr(model, "MAX_TEXT_NUMBERS", 3)
    assert sorted(distances(points, x[:9].tolist()).collect()) == expected


def test_arrow_and_column_forms_agree(make_points, x):
    from vecloop.functions.vectors import center_distances, nearest
    from vecloop.operators.model import model_value

    points = make_points(np.round(x, 1))
    centers = np.round(x[:9], 1).tolist()
    with_model = points.withColumn("m", model_value(points.sparkSession, centers))
    by_column = with_model.select("id", nearest(center_distances(F.col("x"), F.col("m"))).alias("cid"))
    assert sorted(assign(points, centers).select("id", "cid").collect()) == sorted(by_column.collect())


def test_distances(make_points, x):
    rows = distances(make_points(x[:20]), x[:3].tolist()).collect()
    assert len(rows) == 60
    for r in rows:
        assert r["distance"] == pytest.approx(((x[r["id"]] - x[r["cid"]]) ** 2).sum())


def test_center_tables(spark):
    old = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 1.0])], "cid int, c array<double>")
    new = spark.createDataFrame([(1, [1.0, 4.0])], "cid int, c array<double>")
    joined = {r["cid"]: (r["old_c"], r["new_c"]) for r in join_centers(old, new).collect()}
    assert joined == {0: ([0.0, 0.0], None), 1: ([1.0, 1.0], [1.0, 4.0])}
    assert {r["cid"]: r["c"] for r in upsert_centers(old, new).collect()} == {0: [0.0, 0.0], 1: [1.0, 4.0]}
    assert center_shift(old, new).first()["shift"] == 9.0
    with pytest.raises(PySparkException, match="no new centre for cluster 0"):
        join_centers(old, new, "error").collect()


def test_cost_is_near_that_of_spark_ml(spark, make_points, x):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = make_points(x)
    ours = train_kmeans(points, 5, 20).costs[-1]
    features = points.select(array_to_vector("x").alias("features"))
    theirs = KMeans(k=5, maxIter=20, seed=1).fit(features).summary.trainingCost
    assert 0.8 < ours / theirs < 1.25
