import numpy as np
import pytest
from pyspark.errors import PySparkException

from vecloop.operators import logistic
from vecloop.operators.logistic import gradient_sum, gradient_terms, initial_weights, train_logistic


def factor(y, d, rule):
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        if rule == "logistic":
            return (1 / (1 + np.exp(-y * d)) - 1) * y
        return (1 - 1 / (1 - y * np.exp(d))) * -y


def loop(x, y, w, iterations, rule="logistic", step=1.0):
    """The trainer, written plainly."""
    history = [np.array(w, float)]
    for _ in range(iterations):
        g = sum(factor(yi, xi @ history[-1], rule) * xi for xi, yi in zip(x, y))
        history.append(history[-1] + (-g if rule == "logistic" else g) * step)
    return np.array(history)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    return rng.random((200, 5)), np.where(rng.random(200) < 0.5, -1.0, 1.0)


@pytest.mark.parametrize("rule", ["logistic", "alt"])
@pytest.mark.parametrize("step", [1.0, 0.01])
def test_equals_plain_loop(make_points, data, rule, step):
    x, y = data
    w = [0.3, -0.2, 0.1, 0.5, -0.4]
    model = train_logistic(make_points(x, y), 6, w, rule=rule, step=step)
    np.testing.assert_allclose(model.weights, loop(x, y, w, 6, rule, step), rtol=1e-9)
    assert len(model.durations_ns) == 6 and min(model.durations_ns) > 0


@pytest.mark.parametrize("rule", ["logistic", "alt"])
@pytest.mark.parametrize("extra", [5, 120])
def test_wide_vectors(make_points, rule, extra):
    rng = np.random.default_rng(3)
    width = logistic.UNROLL_WIDTH + extra
    x, y = rng.random((60, width)), np.where(rng.random(60) < 0.5, -1.0, 1.0)
    w = list(rng.random(width) - 0.5)
    model = train_logistic(make_points(x, y), 3, w, rule=rule)
    np.testing.assert_allclose(model.weights, loop(x, y, w, 3, rule), rtol=1e-9)


@pytest.mark.parametrize("width", [4, 40, 150])
def test_two_step_merge(make_points, width):
    rng = np.random.default_rng(5)
    x, y = rng.random((50, width)), np.where(rng.random(50) < 0.5, -1.0, 1.0)
    points, w = make_points(x, y, 9), [0.1] * width
    one, two = gradient_sum(points, w).first(), gradient_sum(points, w, fan_in=3).first()
    assert one["n"] == two["n"] == 50 and one["pid"] == two["pid"]
    np.testing.assert_allclose(one["g"], two["g"], rtol=1e-12)


def test_trainer_merges_in_two_steps(make_points, data, monkeypatch):
    x, y = data
    monkeypatch.setattr(logistic, "WIDE_FAN_IN", 4)
    model = train_logistic(make_points(x, y, 9), 3, [0.0] * 5)
    np.testing.assert_allclose(model.weights, loop(x, y, [0.0] * 5, 3), rtol=1e-9)


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_any_partitioning(make_points, data, partitions):
    x, y = data
    model = train_logistic(make_points(x, y, partitions), 4, [0.1] * 5)
    np.testing.assert_allclose(model.weights, loop(x, y, [0.1] * 5, 4), rtol=1e-9)


def test_uncached_and_resumed(make_points, data):
    x, y = data
    points = make_points(x, y)
    whole = train_logistic(points, 6, [0.1] * 5)
    uncached = train_logistic(points, 6, [0.1] * 5, cache=False)
    np.testing.assert_allclose(whole.weights, uncached.weights, rtol=1e-12)
    half = train_logistic(points, 3, [0.1] * 5)
    rest = train_logistic(points, 3, half.final, first_iter=3)
    np.testing.assert_allclose(whole.final, rest.final, rtol=1e-9)
    assert [r["iter"] for r in rest.history().orderBy("iter").collect()] == [3, 4, 5, 6]


def test_nothing_stays_cached(spark, make_points, data):
    x, y = data
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    train_logistic(make_points(x, y), 2, [0.1] * 5)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_few_partitions_are_spread(make_points, data):
    x, y = data
    trained = train_logistic(make_points(x, y, 1), 5, [0.1] * 5, partitions=6)
    np.testing.assert_allclose(trained.weights, loop(x, y, [0.1] * 5, 5), rtol=1e-9)


@pytest.mark.parametrize("fan_in", [0, 2, 3])
def test_fan_in_changes_no_result(make_points, data, fan_in):
    x, y = data
    trained = train_logistic(make_points(x, y, 7), 3, [0.1] * 5, fan_in=fan_in)
    np.testing.assert_allclose(trained.weights, loop(x, y, [0.1] * 5, 3), rtol=1e-9)


def test_model_size_is_checked(make_points, data):
    x, y = data
    with pytest.raises(ValueError, match="max_model_numbers"):
        train_logistic(make_points(x, y), 1, [0.1] * 5, max_model_numbers=4)


def test_extreme_values_do_not_overflow(make_points):
    rows = gradient_terms(make_points([[1000.0], [-1000.0], [0.0]], [1, 1, -1]), [5.0]).orderBy("id").collect()
    assert [r["factor"] for r in rows] == [0.0, -1.0, 0.5]


def test_alternate_rule_at_its_singularity(make_points):
    points = make_points([[0.0, 2.0], [0.0, 2.0]], [1, -1])
    rows = gradient_terms(points, [3.0, 0.0], "alt").orderBy("id").collect()
    assert rows[0]["factor"] == float("inf") and rows[1]["factor"] == 0.5


def test_start_weights(spark):
    uniform = initial_weights(spark, 50)
    assert uniform == initial_weights(spark, 50) != initial_weights(spark, 50, seed=1)
    assert all(-1 <= v < 1 for v in uniform) and min(uniform) < 0 < max(uniform)
    whole = initial_weights(spark, 50, "int")
    assert all(v == int(v) and 0 <= v <= 99 for v in whole) and len(set(whole)) > 10


def test_width_comes_from_the_data(make_points, data):
    x, y = data
    assert len(train_logistic(make_points(x, y), 1).final) == 5


@pytest.mark.parametrize("weights", [[0.1], [0.1] * 4, [0.1] * 40])
def test_other_width_is_an_error(make_points, weights):
    with pytest.raises(PySparkException, match="expected a vector"):
        train_logistic(make_points([[1.0, 2.0]], [1]), 1, weights)


def test_one_short_row_is_an_error(spark):
    df = spark.createDataFrame([(1.0, [1.0, 2.0]), (1.0, [1.0])], "y double, x array<double>")
    with pytest.raises(PySparkException, match="expected a vector"):
        train_logistic(df, 1, [0.0, 0.0])


def test_missing_values_are_errors(spark):
    missing_x = spark.createDataFrame([(1.0, [1.0, None])], "y double, x array<double>")
    with pytest.raises(PySparkException, match="expected a vector"):
        train_logistic(missing_x, 1, [0.0, 0.0])
    missing_y = spark.createDataFrame([(None, [1.0, 2.0])], "y double, x array<double>")
    with pytest.raises(PySparkException, match="without a label"):
        train_logistic(missing_y, 1, [0.0, 0.0])


def test_no_points_is_an_error(spark):
    empty = spark.createDataFrame([], "y double, x array<double>")
    for weights in ([0.0], [0.0] * 40, [0.0] * 200, None):
        with pytest.raises(ValueError, match="no points"):
            train_logistic(empty, 1, weights)


@pytest.mark.parametrize("width", [5, 40])
def test_the_first_iteration_merges_in_groups(spark, make_points, width, monkeypatch):
    """Its sums are first merged by many tasks, each for some of the partitions, and adaptive execution leaves them apart."""
    monkeypatch.setattr(logistic, "WIDE_FAN_IN", 4)
    rng = np.random.default_rng(3)
    x, y = rng.random((60, width)), np.where(rng.random(60) < 0.5, -1.0, 1.0)
    points = make_points(x, y, 9)
    points.count()
    spark.sparkContext.setJobGroup("merge", "one iteration")
    try:
        train_logistic(points, 1, [0.0] * width, cache=False)
    finally:
        spark.sparkContext.setJobGroup("", "")
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(i) for i in tracker.getJobIdsForGroup("merge")]
    tasks = [stage.numTasks for job in jobs for s in job.stageIds if (stage := tracker.getStageInfo(s))]
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) in tasks
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
