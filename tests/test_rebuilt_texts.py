"""Texts rebuilt from hunks inside rows: equal to SQL where ids repeat or are missing, and without a shuffle where they don't."""

from __future__ import annotations

import pytest

from foliolake.operators import diff, inventory
from foliolake.plans.catalog import ORACLE_SQL, QUERIES
from foliolake.sources import bindings as b

LONG = " ".join(f"w{k % 7}" + " " * (k % 3 == 0) for k in range(700))
WORDS = "one two  three Four 5 six seven eight nine ten eleven  twelve"
ONCE = [(1, WORDS), (2, None), (3, ""), (4, LONG), (5, f"{WORDS}\n{LONG}\n\n{WORDS}"), (6, "a b c d e")]
REPEATED = [(7, WORDS), (7, WORDS), (8, LONG), (8, LONG), (None, f"{WORDS}\nx"), (None, f"{WORDS}\nx")]
#: Words of two texts share places, which SQL's order leaves open.
MIXED = [(9, WORDS), (9, f"{LONG}\n{WORDS}"), (10, WORDS)]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    def make(name: str, rows: list) -> str:
        folder = tmp_path_factory.mktemp(name)
        spark.createDataFrame([(k, t, "en", "s") for k, t in rows], "doc_id long, text string, lang string, source string").coalesce(1).toPandas().to_parquet(f"{folder}/documents.parquet")
        return str(folder)

    return make


def test_repeated_and_missing_ids_are_those_of_sql(spark, table, against_sql):
    against_sql(spark, QUERIES["d3_rebuilt_texts"], ORACLE_SQL["d3_rebuilt_texts"], table("repeated", ONCE + REPEATED))


def test_views_by_id_are_those_of_grouped_segments(spark, table):
    folder = table("mixed", ONCE + REPEATED + MIXED)
    ours, theirs = b.views_by_id(spark, folder), inventory.views(b.segments(spark, folder)).select("package_id", "idx", "original", "final")
    assert sorted(map(repr, ours.collect())) == sorted(map(repr, theirs.collect()))


def test_texts_of_rows_are_those_of_listed_hunks(spark, tiny):
    views = inventory.views(b.segments(spark, tiny))
    theirs = diff.rebuilt(views, diff.word_hunks(views, "original", "final"), "original")
    assert sorted(map(repr, diff.rebuilt_texts(views, "original", "final").collect())) == sorted(map(repr, theirs.collect()))


def test_unique_ids_shuffle_no_text(spark, tiny):
    """Both sides of a join, and words twice before it, were dealt before."""
    rows = QUERIES["d3_rebuilt_texts"](spark, tiny)
    assert rows.collect()
    ran = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")
    assert ran[0].startswith("AdaptiveSparkPlan isFinalPlan=true") and "hashpartitioning" not in ran[0]
    assert ran[1].count("Exchange hashpartitioning") == 1
