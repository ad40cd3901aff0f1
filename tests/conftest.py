import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from keepsake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("keepsake-tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Value of one column expression."""
    return lambda column: spark.range(1).select(column.alias("v")).first()["v"]
