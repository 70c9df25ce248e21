from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_as_sql():
    """Checks that a DataFrame has the rows that DuckDB gets from SQL over the tables at DATA."""
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def cell(v):
        if v is None or v != v:
            return "null"
        return repr(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    def check(df, sql):
        got, want = df.toPandas(), con.execute(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = lambda x: sorted(tuple(map(cell, r)) for r in x[columns].astype(object).itertuples(index=False))
        assert rows(got) == rows(want)

    return check
