import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]").appName("spotrace-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    def build(rows, schema):
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture
def samples_of(spark):
    """Long samples from {(datum, trace_num): values}."""

    def build(traces):
        rows = [
            (d, t, f, float(v)) for (d, t), values in traces.items() for f, v in enumerate(values, 1)
        ]
        return spark.createDataFrame(rows, "datum int, trace_num int, frame int, raw double")

    return build
