import os

import duckdb
import pytest
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """Values in a form that both engines' rows compare in."""
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value


@pytest.fixture(scope="session")
def same_rows(duck):
    def check(df, sql):
        got, want = df.collect(), duck.sql(sql)
        names = sorted(df.columns)
        assert names == sorted(want.columns)
        at = [want.columns.index(n) for n in names]
        left = sorted((tuple(plain(r[n]) for n in names) for r in got), key=repr)
        right = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
        assert left == right

    return check
