"""The physical plans are the ones meant."""

import pytest

from vecloop.operators.kmeans import assign, cluster_sums, distances
from vecloop.operators.logistic import gradient_sum, gradient_terms
from vecloop.operators.sampling import sample_k
from vecloop.plans import queries, views


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_gradient_is_compiled_and_reads_its_columns_only(spark, sf_dir):
    text = plan(gradient_sum(views.points_lr(spark, sf_dir), views.LR_START))
    assert "Python" not in text and "MapInArrow" not in text
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_tax:double,l_returnflag:string>" in text
    assert "partial_sum" in text and text.split("Initial Plan")[0].count("Exchange") == 1


def test_weights_stay_out_of_the_expressions(spark, sf_dir):
    """The model is a subquery's value, so the generated code is the same in every iteration."""
    terms = gradient_terms(views.points_lr(spark, sf_dir), [1.5, 2.5, 3.5, 4.5])
    assert "scalar-subquery" in terms._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("build", [gradient_terms, assign, distances])
def test_the_model_reaches_rows_without_join_or_shuffle(spark, sf_dir, build):
    points = views.points_emb(spark, sf_dir)
    model = [0.5] * 64 if build is gradient_terms else [[0.5] * 64, [0.1] * 64]
    text = plan(build(points, model))
    assert "Join" not in text and "Cartesian" not in text and "Exchange" not in text


def test_clusters_are_summed_before_the_shuffle(spark, sf_dir):
    text = plan(cluster_sums(views.points_emb(spark, sf_dir), [[0.5] * 64, [0.1] * 64]))
    final = text.split("Initial Plan")[0]
    assert final.count("Exchange") == 1 and final.index("Exchange") < final.index("MapInArrow")


def test_sample_is_top_k(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(sample_k(views.points_emb(spark, sf_dir), 10, "id"))


def test_lines_are_parsed_once(spark, sf_dir):
    text = plan(queries.load_points_lenient(spark, sf_dir))
    assert text.count("split(") == 1
