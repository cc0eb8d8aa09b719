import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from helpweave.checks.compare import spark_session

    session = spark_session("4", "4g")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column builder over single texts."""
    def run(fn, *texts):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        out = [r["o"] for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]
        return out if len(out) > 1 else out[0]
    return run
