import os
import sys
import tempfile

import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    """A value as text, numbers alike whatever their type."""
    if value is None or value is pd.NA or value != value:
        return "None"
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int | float):
        return repr(round(float(value), 9) + 0.0)
    return str(value)


@pytest.fixture(scope="session")
def same(duck):
    """Whether a DataFrame and a DuckDB text give the same rows."""

    def check(df, sql):
        ours = df.toPandas()
        theirs = duck.sql(sql).df()
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)
        rows = [sorted(tuple(map(plain, r)) for r in x[columns].astype(object).itertuples(index=False)) for x in (ours, theirs)]
        assert len(rows[0]) == len(rows[1])
        assert rows[0] == rows[1]

    return check
