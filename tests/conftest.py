import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from narrascope.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture()
def one(spark):
    """Evaluate one expression over one row of given values."""

    def run(expr, **values):
        row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
        return row.select(expr.alias("x")).first()["x"]

    return run
