import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.dataset import Dataset  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.default.parallelism", "2")
        .config("spark.sql.session.timeZone", "UTC")
        # Tiny frames: compiling each plan would take longer than running it.
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def make(spark):
    """A Dataset from rows and a DDL schema."""

    def build(rows, schema):
        return Dataset(spark.createDataFrame(rows, schema))

    return build


def table(frame, *columns):
    """Rows as tuples, in order."""
    return [tuple(row) for row in frame.select(*columns).collect()]


def keyed(frame, key, *columns):
    """Rows by key: {key: value or tuple}."""
    rows = frame.select(key, *columns).collect()
    return {row[0]: (row[1] if len(columns) == 1 else tuple(row[1:])) for row in rows}
