from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliolake.functions import keys
from foliolake.operators import diff, inventory
from foliolake.plans.catalog import QUERIES
from foliolake.sources import bindings as b

PK = ["package_id", "idx"]


def test_middles_are_those_of_the_column_function(spark):
    rng = random.Random(5)
    sides = [tuple(["".join(rng.choice("ab")) for _ in range(rng.randint(1, 7))] for _ in range(2)) for _ in range(300)]
    rows = spark.createDataFrame(sides, "a array<string>, b array<string>").select("a", "b", diff._trimmed(F.col("a"), F.col("b")).alias("t")).collect()
    assert all(diff._middles(r.a, r.b) == (r.t.head, r.t.a, r.t.b) for r in rows)


def test_hunk_records_are_those_of_joined_words(spark, tiny):
    """By the words of the segments, joined with the hunks of grouped views."""
    rows = b.segments(spark, tiny)
    found = diff.word_hunks(inventory.views(rows), "original", "final").cache()
    order = Window.partitionBy(*PK).orderBy("k")
    words = rows.filter("in_original").withColumns({"place": F.row_number().over(order) - 1, "at": F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    first = words.select(*PK, F.col("place").cast("long").alias("start"), F.col("at").alias("start_char"))
    theirs = diff.hunk_records(found, words).join(first, [*PK, "start"], "left")
    ours = QUERIES["d3_hunk_records"](spark, tiny)
    assert sorted(map(repr, ours.collect())) == sorted(map(repr, theirs.select(*[F.col(c).cast(kind) for c, kind in ours.dtypes]).collect()))


@pytest.mark.parametrize("name", ["d2_word_hunks", "d3_hunk_records"])
def test_hunks_of_lines_need_no_shuffle(spark, tiny, name):
    plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_places_and_styles_of_odd_lines(spark):
    views = spark.createDataFrame([(1, 0, "a  b", "a b"), (1, 1, "a", "a b"), (1, 2, "", "x"), (None, 0, "é1 2 y", "é1 y")], "package_id long, idx long, a string, b string")
    found = {(r.package_id, r.idx): r for r in diff.styled(diff.placed_hunks(views, "a", "b"), b.style_class, keys.style_id).collect()}
    style = {c: spark.range(1).select(keys.style_id(F.lit(c))).first()[0] for c in ("digit", "other")}
    assert {k: (r.start, r.end, r.start_char, r.source_styles) for k, r in found.items()} == {(1, 0): (1, 2, 2, [style["other"]]), (1, 1): (1, 1, None, []), (1, 2): (0, 1, 0, [style["other"]]), (None, 0): (1, 2, 3, [style["digit"]])}
