import pandas as pd
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def same():
    """Whether a DataFrame and a DuckDB relation hold the same rows under the same names."""

    def value(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if x is None or x is pd.NA or x != x:
            return None
        if isinstance(x, float):
            return int(x) if abs(x) < 1e15 and x == int(x) else round(x, 6) + 0.0  # pandas turns whole numbers beside nulls into these
        return x

    def check(df, relation):
        cols = sorted(df.columns)
        assert cols == sorted(relation.columns)
        rows = lambda pdf: sorted(repr([value(x) for x in r]) for r in pdf[cols].itertuples(index=False))
        assert rows(df.toPandas()) == rows(relation.df())

    return check
