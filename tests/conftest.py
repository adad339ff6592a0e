import os
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from recordloom.session import configure  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


@pytest.fixture(scope="session")
def apply(spark):
    """Apply a function from a string column to a column to a list of texts."""

    def run(values, function):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
        return [row[0] for row in rows.select("i", function(F.col("s")).alias("r")).orderBy("i").select("r").collect()]

    return run


@pytest.fixture(scope="session")
def plan_of():
    """Physical plan text of a table, as planned before it runs."""
    return lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
