"""The registered queries against DuckDB where there is SQL, and the pipeline's stages in a row."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from vecloop.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.splitext(os.path.basename(path))[0]} AS SELECT * FROM '{path}'")
    df = queries.queries()[name](spark, sf_dir)
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, expected))


def test_pipeline(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language_id" and len(corpus_pipeline.STAGES) == 5
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    known = {r["doc_id"]: r["component_id"] for r in queries.op1_simhash_near_dedup(spark, sf_dir).collect()}
    leaked = {r["doc_id"] for r in queries.op6_benchmark_decontamination(spark, sf_dir).collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, c in known.items() if i == c and i not in leaked)
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)
