"""Full outer comparisons, upserts and integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def manifest_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """key, status (added, removed, changed, same) over two manifests."""
    old, new = before.select(key, F.col(digest).alias("old")), after.select(key, F.col(digest).alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return old.join(new, key, "full_outer").select(key, status.alias("status"))


def latest(events: DataFrame, key: str, by: tuple[str, ...]) -> DataFrame:
    """Each key's last row; its first creation time is kept as first_created_at."""
    columns = [c for c in events.columns if c != key]
    row = F.max_by(F.struct(*columns), F.struct(*by))
    found = events.groupBy(key).agg(row.alias("row"), F.min("created_at").alias("first_created_at"), F.count("*").alias("versions"))
    return found.select(key, "row.*", "first_created_at", "versions")


def without_parent(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, check: str) -> DataFrame:
    """check, key for children whose key no parent has."""
    ids = child.select(F.col(child_key).cast("string").alias("key")).distinct()
    return ids.join(parent.select(F.col(parent_key).cast("string").alias("key")).distinct(), "key", "left_anti").select(F.lit(check).alias("check"), "key")


def repeated(rows: DataFrame, key: str, check: str) -> DataFrame:
    return rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(check).alias("check"), "key")


def problems(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def chain_breaks(rows: DataFrame, key: str, order: list[str], link: str, of: str) -> DataFrame:
    """Rows whose ``link`` isn't the ``of`` of the row before in the chain, and whether it is."""
    window = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("expected", F.lag(of).over(window)).withColumn("linked", F.col(link).eqNullSafe(F.col("expected")))
