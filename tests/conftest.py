import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vecloop.session import build_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def make_points(spark):
    """Points from a numpy matrix, and labels if there are any, spread over ``partitions``."""

    def make(x, y=None, partitions=3):
        rows = [(i, [float(v) for v in row]) + (() if y is None else (float(y[i]),)) for i, row in enumerate(x)]
        schema = "id bigint, x array<double>" + ("" if y is None else ", y double")
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return make
