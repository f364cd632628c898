import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mediatimeline.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("4", shuffle_partitions=4, memory="4g")


@pytest.fixture()
def tight(spark):
    """Every group over 15 rows is cut into segments."""
    spark.conf.set("mediatimeline.rowsPerTask", "15")
    yield spark
    spark.conf.unset("mediatimeline.rowsPerTask")


def plan_of(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
