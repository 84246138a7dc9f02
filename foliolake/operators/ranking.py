"""Ranks over whole tables, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolake.sources.shared import written

#: Rows of a range when a table is ordered, at least as many ranges as the session's shuffles have.
ROWS_PER_RANGE = 1 << 20


def ranked(rows: DataFrame, order: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``rows``, written, with their ``rank`` from 0 in the order of some columns, nulls first.

    Ranges are sorted side by side; a row's rank is its place in its range and
    the number of rows in the ranges before, which is one small row for each
    range. Equal rows are told apart by where they stand, so they split too. Pass
    a table that is cheap to read: it is looked at twice.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(width, -(-rows.count() // rows_per_range))
    placed = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(ranges, *order, "_place").sortWithinPartitions(*order, "_place")
    # within a range, monotonically increasing ids count on from the range's number in the upper 31 bits
    at = written(placed.drop("_place").withColumn("_at", F.monotonically_increasing_id()), "ranked")
    sizes = at.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("_range", before.alias("_before"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return at.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(firsts), "_range").withColumn("rank", rank).drop("_range", "_at", "_before")


def ranked_within(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, from 0 in each group, and the group's ``size``; groups must be few, but any may be large."""
    found = ranked(rows, [group, *order])
    groups = found.groupBy(F.col(group).alias("_group")).agg(F.min("rank").alias("_first"), F.count("*").alias("size"))
    return found.join(F.broadcast(groups), found[group].eqNullSafe(F.col("_group"))).withColumn("rank", F.col("rank") - F.col("_first")).drop("_group", "_first")


def percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact discrete percentiles of each group: the value at ceil(share * n), from its rank, with no group gathered."""
    found = ranked_within(rows.filter(F.col(value).isNotNull()).select(group, value), group, [value])
    at = lambda share: F.col("rank") == F.greatest(F.ceil(F.lit(share) * F.col("size")), F.lit(1)) - 1
    return found.groupBy(group).agg(*[F.max(F.when(at(share), F.col(value))).alias(name) for name, share in shares.items()])
