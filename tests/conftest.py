import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{ROOT}/tests{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    built = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoints')}")
        .getOrCreate()
    )
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def as_text(value):
    """A value as both engines' frames show it: nulls alike, and whole numbers alike, which a column with nulls holds as floats."""
    import pandas as pd

    if value is None or value is pd.NA or isinstance(value, float) and value != value:
        return "~"
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def as_rows(frame, columns):
    return sorted(tuple(map(as_text, row)) for row in frame[columns].itertuples(index=False))


@pytest.fixture(scope="session")
def same(duck):
    """Asserts that a query's rows are those of its SQL."""

    def check(df, sql):
        got, wanted = df.toPandas(), duck.sql(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(wanted.columns)
        assert as_rows(got, columns) == as_rows(wanted, columns)

    return check
