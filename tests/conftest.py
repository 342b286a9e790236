import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("millrace-tests")
        .config("spark.sql.shuffle.partitions", "3").config("spark.default.parallelism", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.driver.host", "127.0.0.1").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    for f in os.listdir(SF):
        connection.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return connection


def rows(frame):
    """A pandas frame as a sorted list of plain tuples, columns by name."""
    columns = sorted(frame.columns)
    return sorted(repr(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in frame[columns].itertuples(index=False))
