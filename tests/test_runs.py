import random

import pytest

from vecloop.operators.runs import iteration_durations, number_in_order

ROWS = [("hot", t, t // 3, 10 * t + t % 7) for t in range(600)]
ROWS += [(f"run{i % 40}", 1000 + i, i, 5 * i) for i in range(200)]
ROWS += [("single", 1, 1, 99), (None, 1, 1, 7), (None, 2, 2, 9)]


@pytest.fixture
def ends(spark):
    rows = ROWS[:]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "run string, a bigint, b bigint, end_ns bigint").repartition(5)


def plain():
    expected = {}
    last, seen = {}, {}
    for run, a, b, end in sorted(ROWS, key=lambda r: (str(r[0]), r[2], r[1])):
        seen[run] = seen.get(run, 0) + 1
        expected[(run, a)] = (seen[run], last.get(run))
        last[run] = end
    return expected


@pytest.mark.parametrize("chunks", [1, 2, 17, 200])
def test_long_runs_are_numbered_alike(ends, chunks):
    numbered = number_in_order(ends, ["run"], ["b", "a"], "end_ns", chunks)
    assert {(r["run"], r["a"]): (r["iter"], r["previous"]) for r in numbered.collect()} == plain()
    assert numbered.count() == len(ROWS)


def test_no_task_gets_a_whole_long_run(ends):
    numbered = number_in_order(ends, ["run"], ["b", "a"], "end_ns", 17)
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(chunk" in plan


@pytest.mark.parametrize("chunks", [None, 17])
def test_durations(ends, chunks):
    with_start = ends.selectExpr("*", "CAST(-3 AS BIGINT) AS start_ns")
    rows = iteration_durations(with_start, ["run"], ["b", "a"], "end_ns", "start_ns", chunks).collect()
    durations = {(r["run"], r["a"]): r["duration_ns"] for r in rows}
    assert durations[("single", 1)] == 102
    assert durations[("hot", 0)] == 3
    assert sum(d for (run, _), d in durations.items() if run == "hot") == 10 * 599 + 599 % 7 + 3
    assert (durations[(None, 1)], durations[(None, 2)]) == (10, 2)


def test_no_rows(ends):
    assert number_in_order(ends.where("false"), ["run"], ["b", "a"], "end_ns").count() == 0
