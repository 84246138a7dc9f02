"""Reading input tables and writing intermediate tables to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.sources.shared import scratch as scratch_dir

#: Stands for a null id inside pandas functions, where a null would turn longs into doubles.
NULL_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(texts: pa.Array) -> Iterator[str]:
    """The texts of an Arrow array one by one, nulls as empty ones; a batch never stands twice in memory."""
    return (text.as_py() or "" for text in texts)


def written(df: DataFrame, purpose: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    Cuts the lineage so that a lost executor costs a file read, not the work
    before it, and so that expensive work isn't done once for each use.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """The number of partitions that the session gives to a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filled(column: str = "doc_id") -> Column:
    """An id column without nulls, for use inside Arrow functions."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID)).alias(column)


def restored(column: str = "doc_id") -> Column:
    """The id column of an Arrow function's result, with its nulls."""
    return F.when(F.col(column) != NULL_ID, F.col(column)).alias(column)


def keyed(rows: DataFrame) -> tuple[DataFrame, str]:
    """``rows`` as a Parquet table with a unique row key (a long), and the key's name, which no column of ``rows`` has.

    The key is written, so that it stays the same however often the table is read.
    """
    key = "row_key"
    while key in map(str.lower, rows.columns):
        key += "_"
    return written(rows.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


#: Ids of at most this number (some tens of MB as a hash table) are broadcast; more of them are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def small_side(rows: DataFrame, purpose: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """``rows`` (of a few longs each), written and counted: broadcast in joins up to ``limit`` rows, shuffled beyond."""
    found = written(rows, purpose)
    return F.broadcast(found) if found.count() <= limit else found


def without_ids(rows: DataFrame, ids: DataFrame, column: str = "doc_id", limit: int = BROADCAST_IDS) -> DataFrame:
    """The rows whose id isn't among ``ids`` (one column); a null id is an id like any other.

    Ids are few beside rows with whole texts. They are written and counted first,
    and the texts are left where they are unless there are too many ids.
    """
    gone = small_side(ids.select(F.col(ids.columns[0]).cast("long").alias("gone")).distinct(), "gone", limit)
    return rows.join(gone, rows[column].cast("long").eqNullSafe(gone["gone"]), "left_anti")


#: Keys with this share of all rows, or more, are looked up in a broadcast table; there can't be more of them than HOT_KEYS.
HOT_KEYS = 100_000
HOT_LEAST = 1000


def looked_up(rows: DataFrame, named: DataFrame, keys: list[str], hot_keys: int = HOT_KEYS, least: int = HOT_LEAST) -> DataFrame:
    """``rows`` with what ``named`` says of their keys: it has one row for each key, and in ``n`` how many rows have the key.

    Pass written tables, as both are read twice. Keys are never null. A key that
    holds at least a ``hot_keys``-th of all rows is broadcast, and at most
    ``hot_keys`` of them exist; the rest meet by a shuffle in which no key has
    more rows than that, so that no task depends on how rows are spread.
    """
    total = named.agg(F.sum("n")).first()[0] or 0
    bound = max(least, -(-total // hot_keys))
    hot = F.broadcast(named.filter(F.col("n") >= bound))
    rest = rows.join(F.broadcast(named.filter(F.col("n") >= bound).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(named.filter(F.col("n") < bound), keys))
