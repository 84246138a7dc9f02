from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny() -> str:
    """The smallest of the driver's table folders."""
    if not (DATA / "sf0.001").is_dir():
        pytest.skip("the driver's tables aren't here")
    return str(DATA / "sf0.001")


def values(rows) -> list:
    """Rows of any engine as a sorted list of comparable tuples."""

    def plain(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, list):
            return tuple(map(plain, x))
        if isinstance(x, float):
            return round(x, 9)
        return x

    return sorted((tuple(plain(x) for x in row) for row in rows), key=repr)


@pytest.fixture(scope="session")
def against_sql():
    """Asserts that a query's rows are those of its SQL in DuckDB."""
    import duckdb

    def check(spark, query, sql: str, folder: str) -> None:
        con = duckdb.connect()
        for path in Path(folder).glob("*.parquet"):
            con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        theirs = con.sql(sql)
        columns = sorted(theirs.columns)
        ours = query(spark, folder)
        assert sorted(ours.columns) == columns
        assert values(ours.select(*columns).collect()) == values(theirs.select(*[f'"{c}"' for c in columns]).fetchall())

    return check
