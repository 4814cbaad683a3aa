import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vecloop.functions import vectors as vec


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([([1.0, -2.0, 0.5], [4.0, 0.25, 2.0])], "a array<double>, b array<double>")


def value(df, column):
    return df.select(column.alias("v")).first()["v"]


def test_arithmetic(pair):
    a, b = F.col("a"), F.col("b")
    assert value(pair, vec.dot(a, b)) == 4.5
    assert value(pair, vec.scale(a, F.lit(2.0))) == [2.0, -4.0, 1.0]
    assert value(pair, vec.add(a, b)) == [5.0, -1.75, 2.5]
    assert value(pair, vec.subtract(a, b)) == [-3.0, -2.25, -1.5]
    assert value(pair, vec.squared_distance(a, b)) == 9 + 2.25**2 + 2.25
    assert value(pair, vec.constant(F.lit(3), 2)) == [3.0, 3.0]
    assert value(pair, F.expr(vec.unrolled_dot("a", "b", 3))) == 4.5


@pytest.mark.parametrize("operation", [vec.dot, vec.add, vec.subtract, vec.squared_distance])
def test_unequal_width_is_an_error(pair, operation):
    with pytest.raises(PySparkException, match="unequal width: 3 and 2"):
        value(pair, operation(F.col("a"), F.slice("b", 1, 2)))


@pytest.mark.parametrize(
    "distances, index",
    [([3.0, 1.0, 1.0], 1), ([0.0, 0.0], 0), ([float("nan")] * 2, 0), ([float("nan"), 2.0], 1), ([float("inf")] * 3, 0)],
)
def test_nearest(spark, distances, index):
    df = spark.createDataFrame([(distances,)], "d array<double>")
    assert value(df, vec.nearest(F.col("d"))) == index
