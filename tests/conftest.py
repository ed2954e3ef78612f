import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def plain(value):
    """Comparable across engines: floats rounded, missing values one kind."""
    import pandas as pd

    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if type(value).__name__ == "Decimal":
        value = float(value)
    return round(value, 6) if isinstance(value, float) else value


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def same_rows():
    """Asserts that a Spark query and a DuckDB SQL text give the same columns and rows."""

    def check(df, connection, sql):
        a, b = rows_of(df.toPandas()), rows_of(connection.execute(sql).df())
        assert a[0] == b[0]
        assert len(a[1]) == len(b[1])
        assert a[1] == b[1]

    return check
