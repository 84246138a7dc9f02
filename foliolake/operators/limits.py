"""Resource profiles: what a package may weigh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIB = 1 << 20
# The limits of the daily (S), batch (L) and diagnostic (X) profiles. A value at its limit is accepted.
PROFILES = {
    "S": {"docx_package_mib": 25, "uncompressed_xml_mib": 100, "zip_parts": 2000, "max_leaf_island_bytes": 1048576, "xml_nesting_depth": 512, "compression_ratio_max": 1200},
    "L": {"docx_package_mib": 250, "uncompressed_xml_mib": 1024, "zip_parts": 20000, "max_leaf_island_bytes": 4194304, "xml_nesting_depth": 1024, "compression_ratio_max": 1200},
    "X": {"docx_package_mib": 500, "uncompressed_xml_mib": 2048, "zip_parts": 40000, "max_leaf_island_bytes": 8388608, "xml_nesting_depth": 2048, "compression_ratio_max": 1200},
}


def dimensions(profile: dict[str, float]) -> list[tuple[str, Column, float]]:
    """(dimension, actual, limit) of package statistics, with missing_targets and cycles (``docx.broken_links``) beside those of ``docx.package_stats``."""
    col = F.col
    return [
        ("docx-package-bytes", col("package_bytes"), profile["docx_package_mib"] * MIB),
        ("uncompressed-xml-bytes", col("uncompressed_xml_bytes"), profile["uncompressed_xml_mib"] * MIB),
        ("zip-parts", col("zip_parts"), profile["zip_parts"]),
        ("max-leaf-island-bytes", col("max_part_bytes"), profile["max_leaf_island_bytes"]),
        ("max-text-node-bytes", col("max_text_node_bytes"), profile["max_leaf_island_bytes"]),
        ("xml-nesting-depth", col("xml_nesting_depth"), profile["xml_nesting_depth"]),
        ("compression-ratio", (col("total_bytes") / F.greatest("package_bytes", F.lit(1))).cast("long"), profile["compression_ratio_max"]),
        ("duplicate-entries", col("duplicate_entries"), 0),
        ("relationship-cycle", col("missing_targets") + col("cycles"), 0),
    ]


def violations(stats: DataFrame, profile: dict[str, float]) -> DataFrame:
    """package_id, dimension, actual, most for each limit that a package exceeds; an unreadable one has one row."""
    row = lambda name, actual, most: F.struct(F.lit(name).alias("dimension"), actual.cast("long").alias("actual"), F.lit(int(most)).cast("long").alias("most"))
    checks = F.array(*[row(*d) for d in dimensions(profile)])
    broken = F.array(row("package-validity", F.lit(1), 0))
    found = F.when(F.col("valid"), F.filter(checks, lambda c: c["actual"] > c["most"])).otherwise(broken)
    return stats.select("package_id", F.explode(found).alias("c")).select("package_id", "c.*")
