"""Queries over edited packages: splices written into the built packages, read back member by member.

Each row is a member after the edit: its digest, and whether it stands in the
archive byte for byte as before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.operators import splices
from foliolake.plans import sql
from foliolake.plans.packages import _packages
from foliolake.plans.registry import query
from foliolake.sources import docx, ranged
from foliolake.sources.shared import scratch, written

OLD, NEW, AUTHOR, DATE = "en", "<EN>", "editor", "2020-01-02T00:00:00Z"


def _expected(changed: dict[int, str], kept_notes: str = "c = 5", lines: str = "pline") -> str:
    """The members after an edit of the main part's lines and of the comments."""
    comments, extended = sql.notes(kept_notes)
    return f"""SELECT package_id, part_path, sha256(after) AS sha256, after = content AS stored FROM (SELECT m.package_id, part_path, content,
CASE part_path WHEN 'word/document.xml' THEN document WHEN 'word/comments.xml' THEN comments WHEN 'word/commentsExtended.xml' THEN extended ELSE content END AS after
FROM pmember m JOIN (SELECT package_id, {sql.document(changed)} AS document, {comments} AS comments, {extended} AS extended FROM {lines} GROUP BY package_id) e ON m.package_id = e.package_id)"""


def _spans(packages: DataFrame) -> DataFrame:
    return written(docx.package_spans(packages, splices.WANTED), "spans")


def _after(packages: DataFrame, given: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    edits, _ = splices.disjoint(written(given, "splices"), kept)
    return splices.edited_members(packages.filter("package_id is not null"), edits)


@query("s1_ranged_members", "SELECT package_id, part_path, CAST(strlen(content) AS BIGINT) AS bytes, sha256(content) AS sha256 FROM pmember WHERE part_path IN ('word/document.xml', 'word/comments.xml')")
def s1_ranged(spark, d):
    """Two members of each package, fetched by ranges from files that the tasks wrote."""
    folder = scratch(spark, "files")
    named = _packages(spark, d).withColumn("path", F.concat(F.lit("/"), F.coalesce(F.col("package_id").cast("string"), F.lit("none")), F.lit(".docx")))
    written(docx.write_files(named, folder), "files")
    found = ranged.members(spark, folder).filter(F.col("part_path").isin("word/document.xml", "word/comments.xml"))
    return found.select(F.expr("try_cast(regexp_extract(path, '-(-?[0-9]+)[.]docx$', 1) as bigint)").alias("package_id"), "part_path", "bytes", "sha256")


_PLAIN = sql._run
_BOLD = _PLAIN("w1", properties="<w:rPr><w:b/></w:rPr>")
_HEAD = f"'<w:p><w:pPr><w:rPr></w:rPr></w:pPr>', {_BOLD}"
_MARKS = """'<w:bookmarkStart w:id="', idx, '"/>', {}'<w:bookmarkEnd w:id="', idx, '"/></w:p>'"""


def _settled(spark, d, accept: bool) -> DataFrame:
    packages = written(_packages(spark, d), "packages")
    return _after(packages, *splices.settle(_spans(packages), accept))


@query("s17_accepted_packages", _expected({4: f"concat({_HEAD}, {_PLAIN('w2')}, {_MARKS.format('')})"}))
def s17_accepted(spark, d):
    return _settled(spark, d, True)


@query("s17_rejected_packages", _expected({4: "concat({}, {})".format(_HEAD, _MARKS.format(_PLAIN("w3") + ", "))}))
def s17_rejected(spark, d):
    return _settled(spark, d, False)


@query("d12_comments_removed", _expected({5: f"CASE WHEN idx % 4 = 1 THEN {sql.CASES[0]} ELSE {sql.CASES[5]} END"}, "c = 5 AND idx % 4 <> 1"))
def d12_removed(spark, d):
    """Some comments gone from the packages: entries, anchors, reference runs and extended entries."""
    packages = written(_packages(spark, d), "packages")
    spans = _spans(packages)
    ids = spans.filter("name = 'comment' and cast(ref as long) % 4 = 1").select("package_id", F.col("ref").alias("id"))
    return _after(packages, splices.delete_comments(spans, ids))


@query("d13_rows_written", _expected({1: sql.CASES[1].replace("</w:tr></w:tbl>')", "</w:tr>', CASE WHEN nt % 2 = 0 THEN '<w:tr><w:tc><w:p></w:p></w:tc><w:tc><w:p></w:p></w:tc></w:tr>' ELSE '' END, '</w:tbl>')")}))
def d13_written(spark, d):
    """A row of empty cells after the first row of every other table."""
    packages = written(_packages(spark, d), "packages")
    spans = _spans(packages)
    targets = splices.table_rows(spans).filter("table_index % 2 = 0 and row_index = 0").select("package_id", "table_index", "row_index")
    return _after(packages, splices.insert_rows(spans, targets))


@query("d14_merges_written", _expected({1: f"""CASE WHEN rest = '' OR package_id % 2 = 0 THEN concat('<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p>', {_PLAIN("w1")}, '</w:p></w:tc></w:tr></w:tbl>') ELSE {sql.CASES[1]} END"""}))
def d14_written(spark, d):
    """Both cells of every table's row merged, unless that would lose a text and the package doesn't allow it."""
    packages = written(_packages(spark, d), "packages")
    spans = _spans(packages)
    rows = splices.table_rows(spans).filter("row_index = 0").select("package_id", "table_index", "row_index")
    targets = written(rows.withColumns({"first": F.lit(0), "count": F.lit(2), "discard": F.col("package_id") % 2 == 0}), "targets")
    return _after(packages, splices.merge_cells(spans, targets)[0])


def _once(text: str) -> str:
    return f"length({text}) - length(replace({text}, '{OLD}', '')) = {len(OLD)}"


def _tracked(text: str, first: str, properties: str = "") -> str:
    """A run whose text holds OLD once, cut at it."""
    head, tail = f"split_part({text}, '{OLD}', 1)", f"split_part({text}, '{OLD}', 2)"
    by = lambda n: f"""'w:id="', {n}, '" w:author="{AUTHOR}" w:date="{DATE}">'"""
    run = lambda t, tag="t": _PLAIN(t, tag, properties)
    some = lambda t: f"CASE WHEN {t} <> '' THEN {run(t)} ELSE '' END"
    old, new = f"'{OLD}'", f"'{NEW}'"
    return f"CASE WHEN {_once(text)} THEN concat({some(head)}, '<w:del ', {by(first)}, {run(old, 'delText')}, '</w:del><w:ins ', {by(first + ' + 1')}, {run(new)}, '</w:ins>', {some(tail)}) ELSE {run(text)} END"


_DIRECT = f"CASE WHEN {_once('w2')} THEN replace(w2, '{OLD}', '{NEW}') ELSE w2 END"
_CHANGED = {c: sql.CASES[c].replace(_PLAIN("text"), _tracked("text", "id1")) for c in (0, 2, 3, 5)} | {
    1: sql.CASES[1].replace(_PLAIN("w1"), _tracked("w1", "id1")).replace(_PLAIN("rest"), _tracked("rest", "id2")),
    4: sql.CASES[4].replace(_BOLD, _tracked("w1", "id1", "<w:rPr><w:b/></w:rPr>")).replace(_PLAIN("w2"), _PLAIN(_DIRECT)),
}
_LINES = f"""(SELECT *, most + 1 + 2 * before AS id1, most + 1 + 2 * (before + u1) AS id2 FROM (SELECT *, CAST(coalesce(sum(u1 + u2) OVER (PARTITION BY package_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
coalesce(max(CASE WHEN c = 4 THEN 1000000 + idx END) OVER (PARTITION BY package_id), -1) AS most
FROM (SELECT *, CAST(CASE WHEN c IN (1, 4) THEN {_once("w1")} ELSE {_once("text")} END AS INTEGER) AS u1, CAST(c = 1 AND {_once("rest")} AS INTEGER) AS u2 FROM pline)))"""


@query("d5_tracked_changes_written", _expected(_CHANGED, lines=_LINES))
def d5_written(spark, d):
    """A literal replaced as a tracked change in every text that holds it once; inside an insertion without a record."""
    packages = written(_packages(spark, d), "packages")
    spans = docx.package_spans(packages, splices.TRACKED)  # looked at once, so not written
    return _after(packages, splices.track_replacements(spans, OLD, NEW, AUTHOR, DATE)[0])
