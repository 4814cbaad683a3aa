"""Every registered query against its SQL in DuckDB, on the test tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from vecloop.plans import oracles, queries, views
from vecloop.plans.matrix import run_matrix

QUERIES = queries.queries()
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, result.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["iteration_durations", "metrics_union"])
def test_any_time_zone(spark, sf_dir, duck, name):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        test_query_equals_sql(spark, sf_dir, duck, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_matrix_times_every_iteration(spark, sf_dir):
    points = views.points_emb(spark, sf_dir)
    _, times = run_matrix(points, points, [0.0] * 64, views.first_centers(spark, sf_dir), 3)
    rows = times.collect()
    runs = {(r["engine"], r["algo"]) for r in rows}
    assert runs == {(e, a) for e in ("cached", "uncached") for a in ("lr", "kmeans")}
    assert sorted(r["iter"] for r in rows) == sorted([1, 2, 3] * 4)
    assert all(r["duration_ns"] > 0 for r in rows)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["iter", "pos", "v"]
    assert df.count() == 44
