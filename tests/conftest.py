import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from talkweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "8"), "talkweave-tests", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Value of a Column function for each given text."""

    def run(fn, *values):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
        got = [r.x for r in rows.select("i", fn(F.col("c")).alias("x")).orderBy("i").collect()]
        return got[0] if len(values) == 1 else got

    return run
