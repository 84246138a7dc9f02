"""Character audits with policies: candidates, decisions, change records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.functions.keys import sha
from foliolake.functions.text import codepoint, context, word_starts

PK = ["package_id", "idx"]
RISKY = ("ambiguous", "manual", "unsupported")


def candidates(paragraphs: DataFrame, catalog: DataFrame, pattern: str) -> DataFrame:
    """Each catalogued character of each paragraph with its offset, context, ids and fingerprint.

    ``pattern`` matches the catalog's characters, one at a time. A text cut at
    them gives their offsets by a running sum over the pieces, inside the row;
    only what is found is then dealt by package, to be numbered.
    """
    starts = word_starts(F.split("text", pattern))
    offsets = F.transform(F.slice(starts, 2, F.size(starts)), lambda at: at - 1)
    hits = F.arrays_zip(offsets.alias("offset"), F.regexp_extract_all("text", F.lit(pattern), 0).alias("source"))
    found = paragraphs.filter(F.col("text").rlike(pattern)).select("package_id", "idx", "paragraph_id", "text", F.posexplode(hits).alias("n", "hit")).filter("hit.source is not null")
    offset = F.col("hit.offset")
    placed = found.select(*PK, "paragraph_id", "n", "hit.source", offset.cast("long").alias("visible_offset"), context(F.col("text"), offset).alias("context"))
    in_package = F.row_number().over(Window.partitionBy("package_id").orderBy("idx", "n"))
    return placed.join(F.broadcast(catalog), "source").select(
        *PK,
        "paragraph_id",
        "visible_offset",
        codepoint(F.col("source")).alias("codepoint"),
        "source",
        "target",
        "classification",
        "reversible",
        "context",
        F.concat("paragraph_id", F.lit("-V"), F.lpad((F.col("n") + 1).cast("string"), 4, "0")).alias("occurrence_id"),
        F.concat(F.lit("C"), F.lpad(in_package.cast("string"), 5, "0")).alias("candidate_id"),
    )


def candidate_fingerprint() -> Column:
    return sha(F.concat_ws("|", "occurrence_id", "codepoint", "classification", "context"))


def policy_errors(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each candidate with its package's decision and what is wrong with it, first rule first."""
    both = candidates.join(decisions, "package_id", "left")
    risky = F.col("classification").isin(*RISKY) | ~F.col("reversible")
    error = (
        F.when(F.col("decision").isNull(), "missing-decision")
        .when((F.col("decision") == "approved") & F.col("target").isNull(), "no-target")
        .when((F.col("decision") == "approved") & risky & F.col("rationale").isNull(), "rationale-required")
    )
    return both.withColumns({"risky": risky, "error": error})
