import numpy as np
import pytest
from pyspark.errors import PySparkException

from vecloop.__main__ import main
from vecloop.operators.logistic import train_logistic
from vecloop.session import fresh_path
from vecloop.sources import generate, metrics, models


def test_generate_train_and_summarise(spark, capsys):
    data, model, times = (fresh_path(spark, name) for name in ("data", "model", "times"))
    main(["generate", "labeled", data, "4", "300"])
    main(["lr", data, "3", "--width", "4", "--model", model, "--metrics", times, "--nodes", "25"])
    main(["lr", data, "2", "--width", "4", "--model", model, "--resume", "3", "--no-cache"])
    printed = capsys.readouterr().out
    assert [f"iteration {i} took" in printed for i in range(1, 7)] == [True] * 5 + [False]
    points = generate.labeled_points(generate.ids(spark, 300), 4)
    expected = train_logistic(points, 5).weights
    assert models.weights_history(spark, model).count() == 6
    for i in range(6):
        assert models.load_weights(spark, model, i) == pytest.approx(expected[i], rel=1e-9)

    main(["lr", data, "1", "--width", "4", "--format", "strict", "--model", model, "--resume", "4", "--partitions", "3"])
    assert models.weights_history(spark, model).count() == 6  # the fifth was replaced
    data = fresh_path(spark, "data")
    main(["generate", "vectors", data, "4", "300"])
    main(["kmeans", data, "5", "3", "--width", "4", "--metrics", times, "--nodes", "25"])
    main(["kmeans", data, "5", "2", "--width", "4", "--init", "diagonal", "--empty", "drop", "--metrics", times, "--engine", "other"])
    printed = capsys.readouterr().out
    assert printed.count("center:") == 5 + 2 and "shift" in printed
    rows = metrics.read_metrics_table(spark, times).collect()
    assert sorted((r["engine"], r["algo"], r["nodes"], r["iter"]) for r in rows) == [
        *[("other", "kmeans", 1, i) for i in (1, 2)],
        *[("spark", algo, 25, i) for algo in ("kmeans", "lr") for i in (1, 2, 3)],
    ]
    main(["summary", times, "by-engine"])
    main(["summary", times, "largest"])
    printed = capsys.readouterr().out
    assert "other" in printed and "later" in printed
    main(["summary", times])
    assert capsys.readouterr().out.count("|spark ") == 2


def test_kmeans_resumes(spark, capsys):
    data, model, times = (fresh_path(spark, name) for name in ("data", "model", "times"))
    main(["generate", "vectors", data, "4", "300"])
    main(["kmeans", data, "5", "4", "--width", "4", "--model", model])
    whole = [models.load_centers(spark, model, i) for i in range(5)]
    main(["kmeans", data, "5", "2", "--width", "4", "--model", model, "--resume", "2", "--metrics", times])
    np.testing.assert_allclose([models.load_centers(spark, model, i) for i in range(5)], whole)
    assert sorted(r["iter"] for r in metrics.read_metrics_table(spark, times).collect()) == [3, 4]


def test_bad_lines_stop_the_job_or_are_counted(spark, capsys):
    # Which of several bad lines ends a job is up to the tasks' order, so each gets a job of its own.
    for line, reason in [("1 2", "too few values"), ("1 x 3", "not a number"), ("-1 NaN 1", "not finite")]:
        one = fresh_path(spark, "one")
        spark.createDataFrame([("1 2 3",), (line,)], "value string").write.text(one)
        with pytest.raises(PySparkException, match=f"{reason}: {line}"):
            main(["lr", one, "1", "--width", "2"])
    data, bad = fresh_path(spark, "data"), fresh_path(spark, "bad")
    lines = ["1 2 3", "-1 3 4", "1 2", "1 x 3", "-1 NaN 1", "-1 2"]
    spark.createDataFrame([(v,) for v in lines], "value string").write.text(data)
    main(["lr", data, "1", "--width", "2", "--bad-lines", "reject", "--rejects", bad])
    printed = capsys.readouterr().out
    assert "rejected 2 lines: too few values" in printed and "rejected 1 lines: not finite" in printed
    rows = spark.read.text(bad).collect()
    assert sorted((r["reason"], r["value"]) for r in rows) == [
        ("not a number", "1 x 3"), ("not finite", "-1 NaN 1"), ("too few values", "-1 2"), ("too few values", "1 2"),
    ]


@pytest.mark.parametrize("argv", [[], ["lr"], ["kmeans", "p", "x", "1"], ["lr", "p", "1", "--resume", "3"]])
def test_wrong_arguments(spark, argv):
    with pytest.raises(SystemExit):
        main(argv)


def write(spark, lines, name="data"):
    path = fresh_path(spark, name)
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(path)
    return path


def points(n, width, seed=4):
    rng = np.random.default_rng(seed)
    return [" ".join(map(str, rng.random(width).round(4))) for _ in range(n)]


@pytest.mark.parametrize("keep", [[], ["--no-cache"], ["--table"]])
def test_bad_lines_are_counted_while_training(spark, capsys, keep):
    data = write(spark, points(40, 3) + ["1 2", "x 1 2", "1 2"])
    main(["kmeans", data, "3", "2", "--width", "3", "--bad-lines", "reject", *keep])
    printed = capsys.readouterr().out
    assert printed.count("rejected") == 2
    assert "rejected 2 lines: too few values" in printed and "rejected 1 lines: not a number" in printed


def test_text_is_read_once(spark, tmp_path, monkeypatch):
    """Without the text, a second pass would fail: it is taken away after the first."""
    from vecloop import __main__ as command
    from vecloop.sources import text

    data = tmp_path / "data"
    data.mkdir()
    (data / "part").write_text("\n".join(["1 2 3", "-1 3 4", "1 2"]) + "\n")
    stored = text.store

    def once(*args):
        result = stored(*args)
        (data / "part").unlink()
        return result

    monkeypatch.setattr(command.text, "store", once)
    main(["lr", str(data), "3", "--width", "2", "--bad-lines", "reject", "--rejects", fresh_path(spark, "bad")])


def test_width_of_the_first_record(spark, capsys):
    main(["kmeans", write(spark, ["1 2 3", "4 5 6", "1 2"]), "2", "1", "--format", "whole", "--bad-lines", "reject"])
    printed = capsys.readouterr().out
    assert "rejected 1 lines: wrong number of dimensions" in printed
    assert all(len(line.split()) == 4 for line in printed.splitlines() if line.startswith("center:"))
    main(["lr", write(spark, ["1 2 1", "4 5 -1", "2 1"]), "1", "--format", "label-last", "--bad-lines", "reject"])
    assert "rejected 1 lines: wrong number of dimensions" in capsys.readouterr().out
    with pytest.raises(ValueError, match="no record"):
        main(["kmeans", write(spark, ["x"]), "2", "1", "--format", "whole"])


@pytest.mark.parametrize("blocked", [[], ["--blocked"]])
def test_restart_from_the_latest_complete_iteration(spark, capsys, blocked):
    data, whole, model, times = write(spark, points(60, 3)), *(fresh_path(spark, name) for name in ("whole", "model", "times"))
    run = ["kmeans", data, "4", "5", "--width", "3", "--metrics", times, *blocked]
    main([*run, "--model", whole, "--engine", "whole"])
    main(["kmeans", data, "4", "3", "--width", "3", "--metrics", times, *blocked, "--model", model])
    # A crash within the fourth iteration: its model is there in part, and its time, but not its mark.
    half = models.centers_history(spark, model).where("iter = 3 AND cid < 2").selectExpr("cid", "c", "4 AS iter")
    half.write.mode("append").partitionBy("iter").parquet(model)
    metrics.append_metrics(metrics.metrics_frame(spark, "spark", "kmeans", 1, [5], 4), times)
    assert models.latest_iteration(spark, model) == 3
    capsys.readouterr()
    main([*run, "--model", model, "--resume", "latest"])
    assert "resumed from iteration 3" in (printed := capsys.readouterr().out)
    assert [f"iteration {i} took" in printed for i in range(1, 7)] == [False] * 3 + [True] * 2 + [False]
    for i in range(6):
        assert models.load_centers(spark, model, i) == pytest.approx(np.array(models.load_centers(spark, whole, i)))
    rows = metrics.read_metrics_table(spark, times).where("engine = 'spark'").collect()
    assert sorted(r["iter"] for r in rows) == [1, 2, 3, 4, 5] and all(r["duration_ns"] > 5 for r in rows)
    main([*run, "--model", model, "--resume", "latest"])
    assert "took" not in capsys.readouterr().out
    with pytest.raises(ValueError, match="has 4 centres, not 3"):
        main(["kmeans", data, "3", "5", "--width", "3", *blocked, "--model", model, "--resume", "2"])


def test_latest_iteration(spark):
    path = fresh_path(spark, "model")
    assert models.latest_iteration(spark, path) is None
    for i in (0, 1, 2, 10):
        models.save_history(models.centers_frame(spark, i, [[1.0], [2.0]]), path)
        if i != 1:
            models.commit(spark, path, i)
    assert models.latest_iteration(spark, path) == 10
    models.save_history(models.centers_frame(spark, 10, [[1.0]]), path)  # damaged since
    assert models.latest_iteration(spark, path) == 2
    assert models.centers_history(spark, path).count() == 7  # marks are no models


def test_lr_starts_where_there_is_nothing_to_resume(spark, capsys):
    data, model = write(spark, ["1 2 3", "-1 3 4"]), fresh_path(spark, "model")
    main(["lr", data, "2", "--width", "2", "--model", model, "--resume", "latest"])
    assert "nothing to resume" in capsys.readouterr().out
    assert models.latest_iteration(spark, model) == 2
    main(["lr", data, "3", "--width", "2", "--model", model, "--resume", "latest"])
    assert models.latest_iteration(spark, model) == 3


def test_blocked_needs_a_place(spark):
    with pytest.raises(SystemExit):
        main(["kmeans", "p", "2", "1", "--blocked"])
