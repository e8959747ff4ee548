import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lawloom.session import local_session

    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a Column expression on one text."""
    from pyspark.sql import functions as F

    def run(text, fn):
        df = spark.createDataFrame([(text,)], "t string")
        return df.select(fn(F.col("t")).alias("v")).first()["v"]

    return run
