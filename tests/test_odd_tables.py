"""Every core query over empty tables, and over tables of nulls, repeated rows and columns with clashing names.

Ids name rows in the model, so where they repeat or are missing a query's rows
aren't compared with SQL's; every query must run, and on empty tables have as
many rows as its SQL.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliolake.plans import catalog

CLASHING = ("idx", "k", "kind", "n", "status", "key", "old", "new", "row", "rank", "source", "package_id", "item", "text", "start", "position")


def _odd(rows):
    """Some rows, some of them twice, all of them again with cells missing, and rows of nulls."""
    some = rows.limit(12)
    first, *others = rows.dtypes
    holed = some.select(first[0], *[F.when(F.pmod(F.xxhash64(first[0], F.lit(c)), F.lit(3)) != 0, F.col(c)).alias(c) for c, _ in others])
    nulls = some.limit(2).select(*[F.lit(None).cast(kind).alias(c) for c, kind in rows.dtypes])
    extra = {c: F.lit("x") for c in CLASHING if c not in rows.columns}
    return some.unionByName(some.limit(3)).unionByName(holed).unionByName(nulls).withColumns(extra)


@pytest.fixture(scope="module")
def folders(spark, tiny, tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    for path in Path(tiny).glob("*.parquet"):
        rows = spark.read.parquet(str(path))
        rows.limit(0).coalesce(1).write.parquet(f"{root}/empty/{path.name}")
        _odd(rows).coalesce(1).write.parquet(f"{root}/odd/{path.name}")
    return root


def _each(run) -> dict[str, str]:
    """What went wrong, by query."""

    def tried(name):
        try:
            return name, run(name)
        except Exception as wrong:
            return name, f"{type(wrong).__name__}: {str(wrong)[:200]}"

    with ThreadPoolExecutor(6) as pool:
        return {name: wrong for name, wrong in pool.map(tried, sorted(catalog.QUERIES)) if wrong}


def test_nulls_repeats_and_clashing_names(spark, folders):
    def run(name):
        catalog.QUERIES[name](spark, f"{folders}/odd").write.format("noop").mode("overwrite").save()

    assert _each(run) == {}


def test_empty_tables(spark, folders):
    import duckdb

    con = duckdb.connect()
    for path in (folders / "empty").glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}/*.parquet')")

    def run(name):
        rows = catalog.QUERIES[name](spark, f"{folders}/empty").count()
        if name in catalog.ORACLE_SQL:
            wanted = len(con.cursor().execute(catalog.ORACLE_SQL[name]).fetchall())
            return None if rows == wanted else f"{rows} rows, not {wanted}"

    assert _each(run) == {}
