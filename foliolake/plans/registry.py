"""Where plans register their queries."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.plans.sql import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _with_longs(run: Query) -> Query:
    """Ordinals and counts are longs in every result, as in SQL."""

    @functools.wraps(run)
    def longs(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if kind == "int"})

    return longs


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name; ``sql`` is its equivalent over the tables, if SQL has one."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = _with_longs(run)
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return run

    return register
