import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("the driver's tables are not here")
    return path


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


@pytest.fixture(scope="session")
def equal(duck):
    """Does a DataFrame have the rows of a SQL text, in any order?"""

    def check(df, sql):
        a, b = df.toPandas(), duck.execute(sql).df()
        names = sorted(a.columns)
        assert names == sorted(b.columns)
        a, b = (x[names].sort_values(names).reset_index(drop=True) for x in (a, b))
        assert len(a) == len(b)
        for c in names:
            same = (a[c].isna() & b[c].isna()) | (a[c] == b[c])
            assert same.all(), f"{c}: {a[c][~same].head(3).tolist()} and {b[c][~same].head(3).tolist()}"

    return check
