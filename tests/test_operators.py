"""Operators on small rows made for their traps."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliolake.functions import keys, text
from foliolake.operators import compare, diff, edits, inventory, ranges, review, tables
from foliolake.sources import bindings, shared

SEGMENTS = "package_id long, idx int, k int, text string, start long, end long, style_id string, kind string, w_id string, revision string, in_original boolean, in_final boolean"


def segments(spark, rows):
    """(k, text, style, kind) of one paragraph as segments."""
    out, at = [], 0
    for k, value, style, kind in rows:
        out.append((1, 0, k, value, at, at + len(value), style, kind, str(k) if kind else None, kind and f"document|{kind}|{k}|x", kind not in ("insert", "move_to"), kind not in ("delete", "move_from")))
        at += len(value) + 1
    return spark.createDataFrame(out, SEGMENTS)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_offsets_count_scalar_values(spark):
    frame = spark.createDataFrame([("a😀é…b",)], "t string")
    assert frame.select(text.sub(F.col("t"), F.lit(1), F.lit(3))).first()[0] == "😀é"
    assert frame.select(text.codepoint(F.substring("t", 2, 1))).first()[0] == "U+1F600"
    assert one(spark, text.codepoint(F.lit("é"))) == "U+00E9"


def test_escape_order(spark):
    assert one(spark, text.xml_escape(F.lit("<&\"'>"))) == "&lt;&amp;&quot;&apos;&gt;"
    assert one(spark, text.xml_unescape(F.lit("&amp;lt;"))) == "&lt;"


@pytest.mark.parametrize(("value", "lines"), [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\rc\x0bd e", ["a", "b", "c", "d", "e"]), ("\n\n", ["", ""])])
def test_split_lines_as_python_does(spark, value, lines):
    assert one(spark, text.split_lines(F.lit(value))) == lines == value.splitlines()


@pytest.mark.parametrize(("base", "target", "resolved"), [("word", "media/i.png", "word/media/i.png"), ("word/x", "../../a.xml", "a.xml"), ("word", "/docProps/./app.xml", "docProps/app.xml"), ("w", "../../../a", "a")])
def test_resolved_targets(spark, base, target, resolved):
    assert one(spark, text.resolve_target(F.lit(base), F.lit(target))) == resolved


def test_revision_keys_round_trip_and_reject_others(spark):
    key = keys.revision_key(F.lit("document"), F.lit("insert"), F.lit("7"), F.lit("abc"))
    assert one(spark, F.size(F.split(key, "\\|"))) == 4
    assert tuple(spark.range(1).select(*keys.parse_revision_key(F.lit("a|b|c"))).first()) == (None,) * 4


def test_canonical_json_sorts_keys_and_keeps_nulls(spark):
    assert one(spark, keys.canonical_json({"b": F.lit(1), "a": F.lit(None).cast("string")})) == '{"a":null,"b":1}'


def test_base_style_counts_insertions_not_deletions_and_takes_the_first_on_a_tie(spark):
    rows = segments(spark, [(0, "aa", "x", None), (1, "bb", "y", "insert"), (2, "cccc", "z", "delete")])
    assert inventory.base_style(rows).first().base_style == "x"


def test_views_and_settlements_agree(spark):
    rows = segments(spark, [(0, "a", "x", None), (1, "b", "x", "insert"), (2, "c", "x", "delete"), (3, "d", "x", "move_from"), (4, "e", "x", "move_to")])
    view = inventory.views(rows).first()
    assert (view.original, view.tracked, view.final) == ("a c d", "a b c d e", "a b e")
    settled = lambda accept: [(r.text, r.kind, r.revision) for r in edits.settle(rows, accept).orderBy("k").collect()]
    assert settled(True) == [(t, None, None) for t in "abe"] and settled(False) == [(t, None, None) for t in "acd"]
    once = edits.settle(rows, True, F.col("k") == 2).orderBy("k").collect()
    assert [(r.text, r.kind) for r in once] == [("a", None), ("b", "insert"), ("d", "move_from"), ("e", "move_to")]


def test_nested_ancestry(spark):
    leaves = spark.createDataFrame([(1, 0, k) for k in range(6)], "package_id long, idx int, k int")
    nested = spark.createDataFrame([(1, 0, 0, 4, "insert", "i"), (1, 0, 2, 3, "delete", "d")], "package_id long, idx int, first int, last int, kind string, key string")
    rows = {r.k: (r.innermost, r.in_original, r.in_final) for r in inventory.ancestry(leaves, nested).collect()}
    assert rows == {0: ("i", False, True), 1: ("i", False, True), 2: ("d", False, False), 3: ("i", False, True)}


def test_least_missing_id_is_not_the_greatest_plus_one(spark):
    ids = spark.createDataFrame([(1, 0), (1, 1), (1, 5), (2, 3)], "p long, v long")
    assert {r.p: r.next_id for r in inventory.missing_least(ids, "p", "v").collect()} == {1: 2, 2: 0}


def test_insertions_take_neighbour_styles(spark):
    rows = segments(spark, [(0, "n", "q", "insert"), (1, "a", "x", None), (2, "m", "q", "insert"), (3, "a", "y", None), (4, "o", "q", "insert")])
    found = {r.k: (r.taken_style, r.refused) for r in inventory.neighbour_styles(rows).collect()}
    assert found == {0: ("x", False), 2: (None, True), 4: ("y", False)}


def test_range_joins_equal_nested_loops(spark):
    rng = random.Random(4)
    spans = [(1, f"r{n}", a := rng.randrange(3000), a + rng.randrange(1, 900)) for n in range(40)]
    points = [(1, f"p{n}", rng.randrange(3500)) for n in range(60)]
    right = spark.createDataFrame(spans, "g long, r string, start long, end long")
    found = ranges.containing(spark.createDataFrame(points, "g long, p string, position long"), right, ["g"], bucket=64)
    assert {(x.p, x.r) for x in found.collect()} == {(p, r) for _, p, at in points for _, r, a, b in spans if a <= at < b}
    others = right.selectExpr("g", "r as q", "start as other_start", "end as other_end")
    both = [(x.r, x.q) for x in ranges.overlapping(right, others, ["g"], bucket=64).collect()]
    assert sorted(both) == sorted((r, q) for _, r, a, b in spans for _, q, c, d in spans if a < d and c < b)


def test_orphans_stay_in_a_full_outer_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "k string, d string")
    new = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], "k string, d string")
    assert {r.k: r.status for r in compare.manifest_diff(old, new, "k", "d").collect()} == {"a": "removed", "b": "same", "c": "changed", "d": "added"}


def test_island_edits_refuse_what_is_ambiguous(spark):
    rows = spark.createDataFrame([("20 mg and 250 mg",), ("x",), ("a mg",)], "text string")
    assert {(r.edited, r.code) for r in edits.island_edit(rows, "mg", "g").collect()} == {("20 mg and 250 mg", "ambiguous"), ("x", "not-found"), ("a g", None)}


@pytest.mark.parametrize(("a", "b", "hunk"), [("abc", "abc", (3, "", "")), ("abc", "axc", (1, "b", "x")), ("aaa", "aa", (2, "a", "")), ("", "q", (0, "", "q")), ("héllo wörld", "héllo wrld", (7, "ö", ""))])
def test_trimmed_diffs(spark, a, b, hunk):
    assert tuple(one(spark, edits.trim_diff(F.lit(a), F.lit(b)))) == hunk


def test_table_operations_undo_each_other(spark):
    rows = spark.createDataFrame([(0, 0, ["a", "b", "c"]), (0, 1, ["d", "", "f"])], "table_index int, row_index int, cells array<string>")
    same = lambda frame, order: [tuple(r.cells) for r in frame.orderBy(order).collect()]
    longer = tables.insert_row(rows, 0).withColumnRenamed("new_row", "row_index")
    assert same(tables.delete_row(longer, 1), "new_row") == same(rows, "row_index")
    assert same(tables.delete_column(tables.insert_column(rows, 1), 2), "row_index") == same(rows, "row_index")
    assert same(tables.insert_column(rows, 9), "row_index") == same(rows, "row_index")
    merged = {tuple(r.cells): (r.grid_span, r.code) for r in tables.merge_cells(rows, 0, 2).collect()}
    assert merged == {("a", "b", "c"): (1, "merge-would-discard-content"), ("d", "f"): (2, None)}
    assert {r.code for r in tables.merge_cells(rows, 2, 2).collect()} == {"span-out-of-range"}
    assert same(tables.split_cell(rows, 0, 2), "row_index") == [("a", "", "b", "c"), ("d", "", "", "f")]


def test_ledger_replays_and_rejects(spark):
    rows = spark.createDataFrame([(1, "o", "x"), (2, "o", "x"), (3, "o", "y"), (4, "p", "z")], "n int, op string, input string")
    assert [r.outcome for r in review.ledger(rows, "op", "input", "n").orderBy("n").collect()] == ["ran", "replayed", "rejected", "ran"]


def test_recovery_decisions(spark):
    cases = [("completed", 1, 2, 3, "settle"), ("prepared", 2, 2, 1, "roll-forward"), ("prepared", 1, 2, 1, "roll-back"), ("intent", 9, 2, 1, "quarantine"), ("intent", None, 2, None, "roll-back")]
    frame = spark.createDataFrame(cases, "phase string, pointer int, prepared int, parent int, action string")
    assert all(r[0] == r[1] for r in frame.select(review.recovery(*(F.col(c) for c in ("phase", "pointer", "prepared", "parent"))), "action").collect())


def test_hunks_rebuild_the_text(spark):
    views = spark.createDataFrame([(1, 0, "the old cat sat here", "a cat sat there now"), (1, 1, "same", "same")], "package_id long, idx long, a string, b string")
    hunks = diff.word_hunks(views, "a", "b").collect()
    assert {h.idx for h in hunks} == {0}
    assert diff.apply_hunks("the old cat sat here", [(h.start, h.end, h.new) for h in hunks]) == "a cat sat there now"


def test_grapheme_clusters(spark):
    assert one(spark, text.graphemes(F.lit("é🇩🇪👩‍👩‍👧x"))) == ["é", "🇩🇪", "👩‍👩‍👧", "x"]


def test_versions_are_not_overwritten(spark, tmp_path):
    frame = spark.range(3)
    shared.publish(frame, f"{tmp_path}/v1")
    with pytest.raises(Exception, match="already exists"):
        shared.publish(frame, f"{tmp_path}/v1")


def test_catalog_refuses_another_digest(spark):
    assert bindings.checked_catalog(spark).count() == len(bindings.CATALOG)
    with pytest.raises(ValueError):
        bindings.checked_catalog(spark, "0" * 64)


def test_capability_audit_finds_each_problem(spark):
    from foliolake.operators import qualification

    manifest = spark.createDataFrame([("a", "supported"), ("b", "supported-with-guard"), ("c", "unsupported-by-design"), ("d", "someday"), ("e", "supported"), ("f", "supported")], "capability string, state string")
    mapped = spark.createDataFrame([("a", "supported"), ("b", "supported-with-guard"), ("c", "unsupported-by-design"), ("e", "retired"), ("f", "supported"), ("z", "supported")], "capability string, state string")
    referenced = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("e", "4"), ("a", "4"), ("e", "5"), ("e", "6"), ("e", "8")], "capability string, case string")
    cases = spark.createDataFrame(
        [("1", "a", "task", "positive"), ("2", "b", "matrix", "positive"), ("3", "c", "matrix", "positive"), ("4", "e", "task", "positive"), ("5", "a", "task", "positive"), ("6", "e", "other", None), ("7", "a", None, None)],
        "case string, capability string, kind string, probe string",
    )
    found = {tuple(r) for r in qualification.capability_audit(manifest, mapped, referenced, cases).collect()}
    assert found == {
        ("one-sided-guard", "b"), ("no-negative-case", "c"), ("unknown-state", "d"), ("missing-from-map", "d"), ("state-differs", "e"), ("empty-case-set", "f"), ("not-in-manifest", "z"),
        ("case-of-several", "4"), ("case-of-another", "5"), ("unknown-kind", "6"), ("case-not-referenced", "7"), ("case-not-declared", "8"),
    }


def test_percentiles_keep_the_group_without_a_name(spark, tmp_path):
    from foliolake.operators import ranking

    frame = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", 2.0), ("x", None)], "g string, v double")
    assert {r.g: r.m for r in ranking.percentiles(frame, "g", "v", {"m": 0.5}).collect()} == {None: 1.0, "x": 2.0}
