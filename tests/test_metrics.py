import random
import statistics

import pytest
from pyspark.errors import PySparkException

from vecloop.operators import timings
from vecloop.operators.kmeans import train_kmeans
from vecloop.operators.logistic import train_logistic
from vecloop.session import fresh_path
from vecloop.sources import metrics, models

ROWS = [
    (engine, "lr", nodes, i, (i * 37 + nodes * 11 + len(engine)) * 10**7)
    for engine in ("hadoop", "spark")
    for nodes in (25, 100)
    for i in range(1, 31)
] + [("spark", "kmeans", 25, 1, 5 * 10**9)]


@pytest.fixture
def runs(spark):
    rows = ROWS[:]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, metrics.METRICS).repartition(6)


def seconds(engine, nodes, first):
    return [d / 1e9 for e, a, n, i, d in ROWS if (e, a, n) == (engine, "lr", nodes) and (i == 1) == first]


def test_first_and_rest(runs):
    found = {(r["engine"], r["algo"], r["nodes"]): (r["first_s"], r["later_s"]) for r in timings.first_vs_rest(runs).collect()}
    assert len(found) == 5
    assert found[("spark", "kmeans", 25)] == (5.0, None)
    for engine in ("hadoop", "spark"):
        for nodes in (25, 100):
            first, rest = seconds(engine, nodes, True)[0], statistics.mean(seconds(engine, nodes, False))
            assert found[(engine, "lr", nodes)] == (pytest.approx(first), pytest.approx(rest))


def test_tables(runs):
    lr = runs.where("algo = 'lr'")
    pivot = {r["nodes"]: (r["hadoop"], r["spark"]) for r in timings.later_by_engine(lr, ["hadoop", "spark"]).collect()}
    assert pivot == {
        n: tuple(pytest.approx(statistics.mean(seconds(e, n, False))) for e in ("hadoop", "spark")) for n in (25, 100)
    }
    assert {r["nodes"]: r["later_s"] for r in timings.one_engine(lr, "spark").collect()} == {n: p[1] for n, p in pivot.items()}
    assert {(r["engine"], r["nodes"]) for r in timings.largest_cluster(runs).collect()} == {("hadoop", 100), ("spark", 100)}
    long = {(r["engine"], r["series"]): r["seconds"] for r in timings.first_later_long(runs).collect()}
    assert long[("hadoop", "first")] == pytest.approx(seconds("hadoop", 100, True)[0])
    assert long[("spark", "later")] == pivot[100][1] and len(long) == 4


def test_an_engine_without_a_column_is_an_error(runs):
    with pytest.raises(PySparkException, match="engine without a column: hadoop"):
        timings.later_by_engine(runs, ["spark"]).collect()
    assert timings.engines_of(runs) == sorted({r[0] for r in ROWS})
    with pytest.raises(ValueError, match="more than 1 engines"):
        timings.engines_of(runs, 1)


def test_union(runs):
    parts = [runs.where(f"engine = '{e}' AND nodes = {n}") for e in ("hadoop", "spark") for n in (25, 100)]
    assert sorted(timings.union_runs(parts).collect()) == sorted(runs.collect())


@pytest.mark.parametrize("chunks", [None, 8])
def test_text_keeps_the_order(spark, runs, chunks):
    path = fresh_path(spark, "test")
    metrics.write_metrics_text(runs, path)
    assert sorted(tuple(r) for r in metrics.read_metrics_text(spark, path, chunks).collect()) == sorted(ROWS)


@pytest.mark.parametrize("split_bytes", ["128m", "64"])
def test_plain_files_are_read_in_order(spark, tmp_path, split_bytes):
    durations = [10**9 + i * 7 for i in range(100)]
    for nodes in (25, 100):
        folder = tmp_path / str(nodes)
        folder.mkdir()
        (folder / "sparklr.txt").write_text("".join(f"{d + nodes}\n" for d in durations))
        (folder / "hadoopkmeans.txt").write_text(f"{nodes}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        rows = [tuple(r) for r in metrics.read_metrics_text(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    expected = [("spark", "lr", n, i + 1, d + n) for n in (25, 100) for i, d in enumerate(durations)]
    expected += [("hadoop", "kmeans", n, 1, n) for n in (25, 100)]
    assert sorted(rows) == sorted(expected)


def test_table(spark, runs):
    path = fresh_path(spark, "test")
    metrics.append_metrics(runs.where("nodes = 25"), path)
    metrics.append_metrics(runs.where("nodes = 100"), path)
    assert sorted(tuple(r) for r in metrics.read_metrics_table(spark, path).collect()) == sorted(ROWS)
    metrics.append_metrics(metrics.metrics_frame(spark, "ours", "lr", 8, [30, 20]), path)
    ours = metrics.read_metrics_table(spark, path).where("engine = 'ours'")
    assert sorted(tuple(r) for r in ours.collect()) == [("ours", "lr", 8, 1, 30), ("ours", "lr", 8, 2, 20)]


def test_progress_is_reported(make_points):
    seen = []
    model = train_logistic(make_points([[1.0], [2.0]], [1, -1]), 3, [0.0], on_iteration=lambda *a: seen.append(a))
    assert seen == [(i, model.weights[i], model.durations_ns[i - 1]) for i in (1, 2, 3)]


def test_models_by_iteration(spark, make_points):
    path = fresh_path(spark, "test")
    points = make_points([[1.0, 2.0], [2.0, 1.0], [5.0, 5.0]], [1, -1, 1])
    trained = train_logistic(points, 4, [0.0, 0.5])
    models.save_history(trained.history(), path)
    assert [models.load_weights(spark, path, i) for i in range(5)] == trained.weights
    with pytest.raises(ValueError, match="0 models saved"):
        models.load_weights(spark, path, 9)
    plan = models.weights_history(spark, path).where("iter = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(iter" in plan

    path = fresh_path(spark, "test")
    clusters = train_kmeans(points, 2, 3)
    models.save_history(clusters.history(), path)
    assert [models.load_centers(spark, path, i) for i in range(4)] == clusters.centers
    models.save_history(clusters.history().where("iter = 2"), path)  # again: replaced
    assert models.centers_history(spark, path).count() == 8
    assert models.load_centers(spark, path, 2) == clusters.centers[2]
    clusters.history().where("iter = 3").write.mode("append").partitionBy("iter").parquet(path)
    with pytest.raises(ValueError, match="each once"):
        models.load_centers(spark, path, 3)
    resumed = train_kmeans(points, iterations=2, centers=models.load_centers(spark, path, 1))
    assert resumed.final == clusters.final


def test_any_algorithm_comes_back_from_text(spark):
    rows = [
        (engine, algo, nodes, i, 1000 * i + nodes)
        for engine, algo in (("spark", "lr"), ("spark", "kmeans"), ("spark", "pagerank"), ("s", "parkpagerank"), ("a b/c+d%", "é:x"), ("", "lr"))
        for nodes in (25, 100)
        for i in range(1, 40)
    ]
    path = fresh_path(spark, "te st+%20")
    metrics.write_metrics_text(spark.createDataFrame(rows, metrics.METRICS).repartition(5), path)
    assert sorted(tuple(r) for r in metrics.read_metrics_text(spark, path).collect()) == rows_sorted(rows)
    metrics.write_metrics_text(spark.createDataFrame(rows[:39], metrics.METRICS), path)  # replaces all of it
    assert sorted(tuple(r) for r in metrics.read_metrics_text(spark, path).collect()) == rows_sorted(rows[:39])


def rows_sorted(rows):
    return sorted(tuple(r) for r in rows)


def test_runs_of_others_by_a_table(spark, tmp_path):
    """Hadoop's part files, by number; a plain file; a run with no lines."""
    folder = tmp_path / "25" / "hadoop-pagerank"
    folder.mkdir(parents=True)
    for part in range(12):
        (folder / f"part-r-{part:05}").write_text("".join(f"{part * 10 + k}\n" for k in range(3)))
    (folder / "_SUCCESS").write_text("")
    (tmp_path / "one.log").write_text("5\n6\n")
    runs = metrics.runs_frame(
        spark, [("25/hadoop-pagerank", "hadoop", "pagerank", 25), ("one.log", "ours", "svd", 3), ("none", "ours", "lr", 3)]
    )
    found = metrics.read_metrics_text(spark, str(tmp_path), runs=runs).collect()
    expected = [("hadoop", "pagerank", 25, 3 * part + k + 1, part * 10 + k) for part in range(12) for k in range(3)]
    assert rows_sorted(found) == rows_sorted([*expected, ("ours", "svd", 3, 1, 5), ("ours", "svd", 3, 2, 6)])
    with pytest.raises(PySparkException, match="not a file of metrics: one.log"):
        metrics.read_metrics_text(spark, str(tmp_path), runs=runs.where("folder <> 'one.log'")).collect()
    with pytest.raises(PySparkException, match="not a file of metrics"):
        metrics.read_metrics_text(spark, str(tmp_path)).collect()


def test_a_run_without_a_name_is_not_written(spark):
    rows = spark.createDataFrame([("spark", None, 25, 1, 5)], metrics.METRICS)
    with pytest.raises(PySparkException, match="a run without"):
        metrics.write_metrics_text(rows, fresh_path(spark, "test"))


def test_an_iteration_appended_again_is_one_row(spark, runs):
    path = fresh_path(spark, "test")
    metrics.append_metrics(runs, path)
    metrics.append_metrics(runs.where("iter > 20"), path)
    assert rows_sorted(metrics.read_metrics_table(spark, path).collect()) == rows_sorted(ROWS)
    again = runs.where("engine = 'spark' AND iter > 20").withColumn("duration_ns", runs["duration_ns"] - 7)
    metrics.append_metrics(again, path)
    expected = [(e, a, n, i, d - 7 * (e == "spark" and i > 20)) for e, a, n, i, d in ROWS]
    assert rows_sorted(metrics.read_metrics_table(spark, path).collect()) == rows_sorted(expected)


def test_a_table_of_before_attempts_were_kept_is_read(spark, runs):
    path = fresh_path(spark, "test")
    runs.write.partitionBy("engine", "algo").parquet(path)
    metrics.append_metrics(runs.where("iter = 1").withColumn("duration_ns", runs["duration_ns"] + 1), path)
    expected = [(e, a, n, i, d + (i == 1)) for e, a, n, i, d in ROWS]
    assert rows_sorted(metrics.read_metrics_table(spark, path).collect()) == rows_sorted(expected)
