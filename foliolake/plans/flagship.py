"""The flagship query: what an editor asks first of every package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.functions import keys
from foliolake.plans.registry import query
from foliolake.sources import bindings as b

_SQL = """WITH s AS (SELECT *, sum(length(text)) OVER (PARTITION BY package_id, style_id) AS weight, min(idx * 1000000 + k) OVER (PARTITION BY package_id, style_id) AS first_at FROM segment)
SELECT package_id, count(DISTINCT idx) AS paragraphs, count(*) AS leaves, CAST(sum(CASE WHEN in_final AND NOT regexp_matches(text, '[0-9]') THEN length(text) ELSE 0 END) AS BIGINT) AS editable_chars,
arg_max(style_id, weight * 1000000000 - first_at) AS base_style, sha256(string_agg(text, ' ' ORDER BY idx, k)) AS text_sha256 FROM s GROUP BY package_id"""


@query("flagship_package_summary", _SQL)
def package_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per package: paragraphs, leaves, editable characters, the style with most characters, digest of the canonical text.

    Leaves are counted by style where they are; a package has a row for each style
    when it is dealt. The canonical text is the text with its lines joined by
    spaces, so its digest needs no leaves.
    """
    leaves = b.segments(spark, sf_dir)
    editable = F.col("in_final") & ~F.col("text").rlike("[0-9]")
    styles = leaves.groupBy("package_id", "style_id").agg(
        F.max("idx").alias("last"),
        F.count("*").alias("leaves"),
        F.sum(F.when(editable, F.length("text")).otherwise(0)).alias("editable_chars"),
        F.sum(F.length("text")).alias("weight"),
        F.min(F.struct("idx", "k")).alias("first"),
    )
    rank = F.struct("weight", -F.col("first.idx"), -F.col("first.k"))
    counted = styles.groupBy("package_id").agg(
        (F.max("last") + 1).cast("long").alias("paragraphs"),
        F.sum("leaves").alias("leaves"),
        F.sum("editable_chars").alias("editable_chars"),
        F.max_by("style_id", rank).alias("base_style"),
    )
    digests = b.packages(spark, sf_dir).select("package_id", keys.sha(F.translate("text", "\n", " ")).alias("text_sha256"))
    return counted.join(digests, "package_id")
