"""Joins of positions and ranges.

Ranges are listed once for each bucket of positions that they touch, so the join
has equality keys and its work follows the sizes of its sides, not their product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET = 512


def _bucketed(ranges: DataFrame, start: str, end: str, bucket: int) -> DataFrame:
    first, last = F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket)
    return ranges.filter(F.col(end) > F.col(start)).withColumn("bucket", F.explode(F.sequence(first, last)))


def containing(points: DataFrame, ranges: DataFrame, keys: list[str], position: str = "position", start: str = "start", end: str = "end", bucket: int = BUCKET) -> DataFrame:
    """Every pair of a point and a range of the same keys with start <= position < end."""
    at = points.withColumn("bucket", F.floor(F.col(position) / bucket))
    found = at.join(_bucketed(ranges, start, end, bucket), [*keys, "bucket"])
    return found.filter((F.col(start) <= F.col(position)) & (F.col(position) < F.col(end))).drop("bucket")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """Every pair of ranges (start, end) and (other_start, other_end) of the same keys that share a position."""
    found = _bucketed(left, "start", "end", bucket).join(_bucketed(right, "other_start", "other_end", bucket), [*keys, "bucket"])
    both = (F.col("start") < F.col("other_end")) & (F.col("other_start") < F.col("end"))
    # a pair meets in each bucket that both touch: keep the first
    return found.filter(both & (F.col("bucket") == F.floor(F.greatest("start", "other_start") / bucket))).drop("bucket")
