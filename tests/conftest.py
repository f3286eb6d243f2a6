import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veilspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", shuffle_partitions=4, memory="4g")


@pytest.fixture
def one(spark):
    """Evaluate expression text over a single row of named values."""
    from pyspark.sql import functions as F

    def run(expr, **values):
        row = spark.createDataFrame([tuple(values.values())],
                                    ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
        return row.select(F.expr(expr).alias("x")).first()[0]
    return run
