"""Edits of packages deal spans once and read new archives where they are made."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F
from test_packages import REVISED, package
from test_splices import frame, odd_archive

from foliolake.operators import splices
from foliolake.plans import rewrites
from foliolake.sources import docx


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def listed(rows) -> list:
    return sorted(map(repr, rows.collect()))


@pytest.fixture(scope="module")
def packages(spark, tiny):
    """Built packages, and some that are odd or can't be read."""
    odd = frame(spark, b"no zip", None, package(REVISED), odd_archive(), package("<w:document><w:p>"))
    return rewrites._packages(spark, tiny).filter("package_id < 40").unionByName(odd.selectExpr("package_id + 1000 as package_id", "content")).cache()


def test_tracked_replacements_deal_spans_once(spark, packages):
    """Three joins and windows each dealt all spans before."""
    edits, _ = splices.track_replacements(docx.package_spans(packages, splices.TRACKED), "en", "x", "me", "2020")
    assert "Join" not in plan(edits) and len(re.findall(r"Exchange hashpartitioning", plan(edits))) == 1


def test_replacements_need_only_some_spans(packages):
    run = lambda names: splices.track_replacements(docx.package_spans(packages, names), "en", "x", "me", "2020")
    assert all(listed(a) == listed(b) for a, b in zip(run(splices.TRACKED), run(splices.WANTED), strict=True))


def test_spans_of_packages_are_those_of_their_members(packages):
    ours, theirs = docx.package_spans(packages, splices.WANTED), docx.spans(docx.members(packages).filter("error is null"), splices.WANTED)
    assert ours.count() > 1000 and listed(ours) == listed(theirs)
    above = ours.select("package_id", "part_path", F.col("idx").alias("parent_idx"), F.col("name").alias("n"), F.col("start").alias("a"), F.col("end").alias("z"))
    both = ours.join(above, ["package_id", "part_path", "parent_idx"])
    assert both.count() > 500 and both.filter("n <> parent_name or a <> parent_start or z <> parent_end").isEmpty()


def test_edited_members_are_those_of_edited_packages(packages):
    edits = splices.disjoint(*splices.settle(docx.package_spans(packages, splices.WANTED), True))[0]
    key = ["package_id", "part_path"]
    edited = splices.applied(packages, edits)
    was, now = docx.stored_members(packages).withColumnRenamed("stored_sha256", "was"), docx.stored_members(edited)
    stored = now.join(was, key).select(*key, (F.col("was") == F.col("stored_sha256")).alias("stored"))
    theirs = docx.members(edited).select(*key, "sha256").join(stored, key)
    ours = splices.edited_members(packages, edits)
    assert listed(ours) == listed(theirs.select(*ours.columns)) and ours.filter("stored").count() > 0 < ours.filter("not stored").count()


def test_replacements_in_nested_and_odd_runs(spark):
    """A run around a text box, a text in a deletion that follows an insertion, texts whose parent is no run, two packages with own numbers."""
    run = lambda t, inner="": f"<w:r>{inner}<w:t>{t}</w:t></w:r>"
    box = f"<w:r><w:rPr><w:i/></w:rPr><w:drawing><w:txbxContent><w:p>{run('old in')}</w:p></w:txbxContent></w:drawing><w:t>out</w:t></w:r>"
    body = f'<w:document><w:body><w:p>{box}<w:ins w:id="4"/><w:ins w:id="9">{run("a old")}</w:ins><w:del w:id="2">{run("old b")}</w:del><w:t>old bare</w:t>{run("old last")}</w:p></w:body></w:document>'
    contents = frame(spark, package(body), package(f"<w:document><w:p>{run('old')}</w:p></w:document>"))
    edits, refused = splices.track_replacements(docx.package_spans(contents, splices.TRACKED), "old", "new", "me", "d")
    assert [r.code for r in refused.collect()] == ["in-deletion"]
    by_package = {k: sorted(r.start for r in edits.collect() if r.package_id == k) for k in (0, 1)}
    assert by_package == {0: sorted([body.index("<w:r><w:t>old in"), body.index("<w:t>a old"), body.index("<w:r><w:t>old last")]), 1: [len("<w:document><w:p>")]}
    ids = {k: sorted({int(n) for r in edits.collect() if r.package_id == k for p in r.pieces for n in re.findall(r'w:id="(\d+)"', p.literal or "")}) for k in (0, 1)}
    assert ids == {0: [10, 11, 12, 13], 1: [0, 1]}
