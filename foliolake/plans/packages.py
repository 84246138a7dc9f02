"""Queries over Word packages: members, items, revisions, comments, cells, checks and limits.

The packages are built from the documents, a block for each line, with tables,
text boxes, content controls, tracked changes, comments and bookmarks; then they
are read as any package is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.functions import keys
from foliolake.operators import acceptance, compare, edits, limits, review
from foliolake.plans.registry import query
from foliolake.sources import bindings as b
from foliolake.sources import docx, typed, word
from foliolake.sources.shared import written

DOCUMENT = "part_path = 'word/document.xml'"


def _packages(spark, d) -> DataFrame:
    return docx.packages_from_texts(b.packages(spark, d).select("package_id", "text", F.col("source").alias("header")))


def _members(spark, d) -> DataFrame:
    return docx.members(_packages(spark, d))


def _items(spark, d) -> DataFrame:
    return word.items(_members(spark, d))


def _read(spark, d) -> tuple[DataFrame, DataFrame]:
    """Members (contents of XML parts only) and items, each written once, for queries that look at them several times."""
    xml = F.when(F.col("part_path").endswith(".xml"), F.col("content"))
    members = written(_members(spark, d).withColumn("content", xml), "members")
    return members, written(word.items(members), "items")


@query("s1_package_members", "SELECT package_id, part_path, CAST(strlen(content) AS BIGINT) AS bytes, sha256(content) AS sha256 FROM pmember")
def s1(spark, d):
    return _members(spark, d).select("package_id", "part_path", "bytes", "sha256")


@query("s2_member_manifest", "SELECT package_id, count(*) AS members, sha256(string_agg(concat(part_path, '|', sha256(content)), ';' ORDER BY concat(part_path, '|', sha256(content)))) AS manifest_sha256 FROM pmember GROUP BY package_id")
def s2(spark, d):
    return _members(spark, d).groupBy("package_id").agg(F.count("*").alias("members"), keys.digest_of_rows(F.col("part_path"), F.col("sha256")).alias("manifest_sha256"))


@query("f2_prose_parts", "SELECT package_id, part_path, regexp_extract(part_path, '^word/(.*)[.]xml$', 1) AS part FROM pmember WHERE regexp_matches(part_path, '^word/(document|header[0-9]*|footer[0-9]*|footnotes|endnotes)[.]xml$')")
def f2(spark, d):
    found = docx.prose_part(F.col("part_path"))
    return _members(spark, d).select("package_id", "part_path", found.alias("part")).filter("part is not null")


@query("s4_element_tree", f"""SELECT m.package_id, CAST(len(regexp_extract_all(replace(content, '<!-- <w:p> -->', ''), '<[a-zA-Z]')) AS BIGINT) AS elements, depth - 1 AS max_depth, CAST(m.package_id % 10 = 6 AS BIGINT) AS errors FROM pmember m JOIN pstat s ON m.package_id = s.package_id WHERE {DOCUMENT}""")
def s4(spark, d):
    """Elements of the main parts, of which every tenth lacks an end tag."""
    cut = F.when(F.col("package_id") % 10 == 6, F.replace(F.decode("content", "UTF-8"), F.lit("</w:body>"), F.lit("")).cast("binary")).otherwise(F.col("content"))
    return docx.elements(_members(spark, d).filter(DOCUMENT).withColumn("content", cut)).groupBy("package_id").agg(F.count("idx").alias("elements"), F.max("depth").alias("max_depth"), F.count("error").alias("errors"))


_LEAVES = "SELECT package_id, part, paragraph_id, row_number() OVER (PARTITION BY package_id, part, paragraph_id ORDER BY n) - 1 AS leaf, text, kind AS revision, item = 'opaque' AS opaque FROM pitem WHERE item IN ('text', 'opaque')"


@query("s5_body_paragraphs", f"SELECT package_id, paragraph_id, leaf, text, revision, opaque FROM ({_LEAVES}) WHERE part = 'document'")
def s5(spark, d):
    return docx.prose_leaves(_members(spark, d).filter(DOCUMENT)).select("package_id", "paragraph_id", "leaf", "text", "revision", "opaque")


@query("s6_header_paragraphs", f"SELECT package_id, paragraph_id, leaf, text FROM ({_LEAVES}) WHERE part = 'header1'")
def s6(spark, d):
    return docx.prose_leaves(_members(spark, d).filter("part_path = 'word/header1.xml'")).select("package_id", "paragraph_id", "leaf", "text")


@query("s16_images", "SELECT package_id, 'rId1' AS rel_id, 'word/media/image1.png' AS part_path, base64(encode(text)) AS base64 FROM package")
def s16(spark, d):
    return docx.images(_members(spark, d)).select("package_id", "rel_id", "part_path", "base64")


@query("s17_patched_members", """SELECT package_id, part_path, CASE WHEN part_path = 'word/header1.xml' AND package_id % 3 <> 0 THEN 'changed' ELSE 'same' END AS status,
CASE WHEN part_path = 'word/header1.xml' AND package_id % 3 <> 0 THEN sha256('<w:hdr/>') ELSE sha256(content) END AS sha256 FROM pmember""")
def s17(spark, d):
    built = _packages(spark, d)
    patched = docx.with_header(built, F.when(F.col("package_id") % 3 != 0, "<w:hdr/>"))
    key = F.concat_ws("|", F.col("package_id").cast("string"), "part_path").alias("member")
    before, after = (docx.members(p).select(key, "package_id", "part_path", "sha256") for p in (built, patched))
    return compare.manifest_diff(before, after, "member", "sha256").join(after, "member").select("package_id", "part_path", "status", "sha256")


_SEGMENTS = """sg AS (SELECT package_id, part, paragraph_id, k, text, "end" - length(text) AS start, "end", concat('s_', left(sha256(style), 16)) AS style_id,
CASE WHEN kind IS NOT NULL THEN concat_ws('|', concat('word/', part, '.xml'), kind, w_id, left(sha256(text), 12)) END AS revision, kind IS DISTINCT FROM 'insert' AS in_original, kind IS DISTINCT FROM 'delete' AS in_final, idx, n FROM
(SELECT *, row_number() OVER w - 1 AS k, CAST(sum(length(text)) OVER w AS BIGINT) AS "end" FROM pitem WHERE item = 'text' WINDOW w AS (PARTITION BY package_id, part, paragraph_id ORDER BY n)))"""


@query("s8_package_segments", f'WITH {_SEGMENTS} SELECT package_id, part, paragraph_id, k, text, start, "end", style_id, revision, in_original, in_final FROM sg')
def s8(spark, d):
    return word.segments(_items(spark, d)).select("package_id", "part", "paragraph_id", "k", "text", "start", "end", "style_id", "revision", "in_original", "in_final")


@query("f4_package_locks", """SELECT package_id, paragraph_id, kind, w_id, string_agg(text, '' ORDER BY n) FILTER (item = 'text') AS text, CASE WHEN bool_and(item = 'mark') THEN 'paragraph-mark-revision' END AS reason, NOT bool_and(item = 'mark') AS editable,
CASE WHEN bool_and(item = 'mark') THEN 'paragraph-mark' END AS scope FROM pitem WHERE kind IS NOT NULL GROUP BY ALL""".replace("string_agg(text, '' ORDER BY n) FILTER (item = 'text')", "coalesce(string_agg(text, '' ORDER BY n) FILTER (item = 'text'), '')"))
def f4(spark, d):
    return word.revisions(_items(spark, d)).select("package_id", "paragraph_id", "kind", "w_id", "text", "reason", "editable", "scope")


@query("j1_package_comments", "SELECT l.package_id, CAST(idx AS VARCHAR) AS id, source AS author, concat('note ', idx) AS text, CAST(3 AS BIGINT) AS anchors, concat('P', np) AS paragraph_id FROM pline l WHERE c = 5")
def j1(spark, d):
    members, items = _read(spark, d)
    anchors = word.comment_anchors(items).groupBy("package_id", "id").agg(F.count("*").alias("anchors"), F.min_by("paragraph_id", "ordinal").alias("paragraph_id"))
    both = docx.comment_entries(members).join(anchors, ["package_id", "id"], "full_outer")
    return both.select("package_id", "id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("author", "text")], F.coalesce("anchors", F.lit(0)).alias("anchors"), "paragraph_id")


@query("w5_package_open_comments", "SELECT package_id, text, CAST(idx AS VARCHAR) AS comment_ids FROM pline WHERE c = 5")
def w5(spark, d):
    items = written(_items(spark, d), "items")
    texts = items.filter("item = 'text'").select("package_id", "part", "position", "text")
    return texts.join(word.open_comments(items), ["package_id", "part", "position"]).select("package_id", "text", F.array_join("comment_ids", ",").alias("comment_ids"))


@query("a7_package_cells", "SELECT package_id, CAST(nt AS BIGINT) AS table_index, CAST(0 AS BIGINT) AS row_index, CAST(unnest([0, 1]) AS BIGINT) AS col_index, unnest([w1, rest]) AS text FROM pline WHERE c = 1")
def a7(spark, d):
    return word.cells(word.paragraphs(_items(spark, d)))


@query("a21_semantic_signature", f"""WITH {_SEGMENTS}, t AS (SELECT package_id, sha256(coalesce(string_agg(text, '|' ORDER BY part, idx, n) FILTER (in_final), '')) AS text_sha256, CAST(coalesce(sum(length(text)) FILTER (in_final), 0) AS BIGINT) AS chars FROM sg GROUP BY package_id)
SELECT t.package_id, text_sha256, chars, count(*) FILTER (item = 'mark') AS marks, count(*) FILTER (item = 'text' AND kind = 'insert') AS inserts, count(*) FILTER (item = 'text' AND kind = 'delete') AS deletes, count(*) FILTER (item = 'comment-reference') AS comments,
count(*) FILTER (item = 'bookmark-start') AS bookmarks, count(*) FILTER (item = 'opaque') AS opaques, CAST(2 AS BIGINT) AS relationships FROM t JOIN pitem i ON t.package_id = i.package_id GROUP BY ALL""")
def a21(spark, d):
    members = _members(spark, d)
    items = word.items(members)
    seen = (F.col("item") == "text") & ~word.hidden(True)
    rows = F.sort_array(F.collect_list(F.when(seen, F.struct("idx", "position", "text"))))
    of = lambda item, kind=None: F.count_if((F.col("item") == item) & (F.lit(True) if kind is None else F.exists("revisions", lambda r: r["kind"] == kind)))
    found = items.groupBy("package_id").agg(
        keys.sha(F.array_join(F.transform(rows, lambda r: r["text"]), "|")).alias("text_sha256"),
        F.sum(F.when(seen, F.length("text")).otherwise(0)).alias("chars"),
        of("mark").alias("marks"), of("text", "insert").alias("inserts"), of("text", "delete").alias("deletes"), of("comment-reference").alias("comments"), of("bookmark-start").alias("bookmarks"), of("opaque").alias("opaques"),
    )
    return found.join(docx.relationships(members).groupBy("package_id").agg(F.count("*").alias("relationships")), "package_id")


@query("a24_fixture_profile", """SELECT package_id, CAST(7 AS BIGINT) AS parts, count(DISTINCT concat(part, paragraph_id)) AS paragraphs, count(DISTINCT concat(part, paragraph_id)) - count(DISTINCT paragraph_id) FILTER (item = 'opaque') AS editable,
count(DISTINCT style) FILTER (item = 'text') AS styles, list_sort(list(DISTINCT item)) AS kinds FROM pitem GROUP BY package_id""")
def a24(spark, d):
    members, items = _read(spark, d)
    shape = word.paragraphs(items).groupBy("package_id").agg(F.count("*").alias("paragraphs"), F.count_if("editable").alias("editable"))
    kinds = items.groupBy("package_id").agg(F.count_distinct(F.when(F.col("item") == "text", F.col("style"))).alias("styles"), F.sort_array(F.collect_set("item")).alias("kinds"))
    return members.groupBy("package_id").agg(F.count("*").alias("parts")).join(shape, "package_id").join(kinds, "package_id")


_SETTLED = """SELECT {0} AS accepted, package_id, part, paragraph_id, item, text, ref, last_value(CASE WHEN item = 'text' THEN text END IGNORE NULLS) OVER (PARTITION BY package_id, part, paragraph_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after
FROM pitem WHERE item <> 'mark' AND (item LIKE '%-%' OR kind IS DISTINCT FROM '{1}')"""


@query("d10_settled_packages", f"{_SETTLED.format('true', 'delete')} UNION ALL {_SETTLED.format('false', 'insert')}")
def d10(spark, d):
    """Both settlements, with the text that each item follows: anchors in removed text stand where it was."""
    items = _items(spark, d)
    order = Window.partitionBy("package_id", "idx").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    after = F.last(F.when(F.col("item") == "text", F.col("text")), ignorenulls=True).over(order)
    settled = lambda accept: word.settle(items, accept).select(F.lit(accept).alias("accepted"), "package_id", "part", "paragraph_id", "item", "text", "ref", after.alias("after"))
    return settled(True).unionByName(settled(False))


@query("d12_comments_deleted", """SELECT package_id, count(*) FILTER (idx % 4 <> 1) AS entries, 3 * count(*) FILTER (idx % 4 <> 1) AS anchors, count(*) FILTER (idx % 4 <> 1) AS extended, CAST(0 AS BIGINT) AS after_clearing FROM pline WHERE c = 5 GROUP BY package_id""")
def d12(spark, d):
    """Some comments deleted, with anchors and extended entries; and all of them."""
    members, items = _read(spark, d)
    entries, extended = docx.comment_entries(members), docx.extended_entries(members)
    kept = word.delete_comments(items, entries, extended, entries.filter("cast(id as long) % 4 = 1"))
    none = word.delete_comments(items, entries, extended)
    anchors = lambda rows: rows.filter(F.col("item").startswith("comment-"))
    count = lambda rows, name: rows.groupBy("package_id").agg(F.count("*").alias(name))
    cleared = none[1].select("package_id").unionByName(anchors(none[0]).select("package_id")).unionByName(none[2].select("package_id"))
    out = entries.select("package_id").distinct()
    for part in (count(kept[1], "entries"), count(anchors(kept[0]), "anchors"), count(kept[2], "extended"), count(cleared, "after_clearing")):
        out = out.join(part, "package_id", "left")
    return out.fillna(0)


@query("s13_typed_round_trip", """SELECT package_id, paragraph_id, item, text, CASE WHEN item = 'text' THEN concat('s_', left(sha256(style), 16)) END AS style_id, ref, kind, w_id FROM pitem WHERE item <> 'mark' AND (item <> 'text' OR text <> '')""")
def s13(spark, d):
    """Items written as typed text and parsed again."""
    last = F.try_element_at("revisions", F.lit(-1))
    items = _items(spark, d).filter("item <> 'mark'").withColumns({"style_id": keys.style_id(F.col("style")), "kind": last["kind"], "w_id": last["w_id"]})
    parsed = typed.parse(typed.serialize(items))
    return parsed.select("package_id", "paragraph_id", "item", "text", F.when(F.col("item") == "text", F.col("style_id")).alias("style_id"), "ref", "kind", "w_id")


# checks of packages of which some are damaged

_ORDER = ("open", "well-formed", "anchors")


def damaged_packages(spark, d) -> DataFrame:
    kind = F.when(F.col("package_id") % 10 == 3, "no-zip").when(F.col("package_id") % 10 == 4, "no-comments").when(F.col("package_id") % 10 == 6, "cut-document")
    return docx.damaged(_packages(spark, d), kind)


def checked(packages: DataFrame) -> DataFrame:
    """package_id, check, result (pass, fail, not-run) for each package; what follows a failed check isn't run."""
    members = written(docx.members(packages), "members")
    opened = members.groupBy("package_id").agg(F.bool_and(F.col("error").isNull()).alias("open"))
    whole = members.filter("error is null")
    formed = docx.elements(whole).groupBy("package_id").agg((F.count("error") == 0).alias("formed"))
    ends = lambda kind: F.count_if(F.col("kind") == kind)
    anchors = word.comment_anchors(word.items(whole)).groupBy("package_id", "id").agg((ends("comment-start") == ends("comment-end")).alias("paired"))
    known = docx.comment_entries(whole).select("package_id", "id", F.lit(True).alias("known"))
    good = anchors.join(known, ["package_id", "id"], "left").groupBy("package_id").agg(F.bool_and(F.col("paired") & F.col("known").isNotNull()).alias("anchored"))
    rows = opened.join(formed, "package_id", "left").join(good, "package_id", "left")
    ok = [F.col("open"), F.coalesce("formed", F.lit(False)), F.coalesce("anchored", F.lit(True))]
    result = lambda k: F.when(F.lit(False) if not k else ~_all(ok[:k]), "not-run").when(ok[k], "pass").otherwise("fail")
    return rows.select("package_id", F.explode(F.array(*[F.struct(F.lit(name).alias("check"), result(k).alias("result")) for k, name in enumerate(_ORDER)])).alias("c")).select("package_id", "c.*")


def _all(conditions: list[Column]) -> Column:
    found = conditions[0]
    for c in conditions[1:]:
        found = found & c
    return found


def _checks(spark, d) -> DataFrame:
    """The checks of all packages, written, as some queries look at them several times."""
    return written(checked(damaged_packages(spark, d)).join(b.packages(spark, d).select("package_id", "source", "lang"), "package_id"), "checks")


_is = lambda result: F.col("result") == result
_FIRST = """coalesce(arg_min("check", CASE "check" WHEN 'open' THEN 0 WHEN 'well-formed' THEN 1 ELSE 2 END) FILTER (result = 'fail'), '{0}')"""


def _first_failure(default: str) -> Column:
    rank = F.array_position(F.array(*[F.lit(c) for c in _ORDER]), F.col("check"))
    return F.coalesce(F.min_by(F.when(_is("fail"), F.col("check")), F.when(_is("fail"), rank)), F.lit(default))


@query("v5_package_violations", """SELECT package_id, "check" AS rule FROM pcheck WHERE result = 'fail'""")
def v5(spark, d):
    return _checks(spark, d).filter(_is("fail")).select("package_id", F.col("check").alias("rule"))


@query("v4_readiness", f"""SELECT state, count(*) AS packages FROM (SELECT package_id, {_FIRST.format("ready")} AS state FROM pcheck GROUP BY package_id) GROUP BY state""")
def v4(spark, d):
    states = _checks(spark, d).groupBy("package_id").agg(_first_failure("ready").alias("state"))
    return states.groupBy("state").agg(F.count("*").alias("packages"))


@query("v12_interop_gate", """WITH e AS (SELECT * FROM pcheck WHERE lang <> 'de' OR "check" <> 'anchors'), r AS (SELECT DISTINCT source AS consumer, "check", lang FROM pcheck)
SELECT r.consumer, r."check" AS phase, count(DISTINCT r.lang) - count(DISTINCT e.lang) AS missing, count(e.result) AS cells, count(*) FILTER (e.result = 'pass') AS passed, count(*) FILTER (e.result = 'not-run') AS not_run,
bool_and(coalesce(e.result, 'missing') = 'pass') AS gate FROM r LEFT JOIN e ON r.consumer = e.source AND r."check" = e."check" AND r.lang = e.lang GROUP BY ALL""")
def v12(spark, d):
    """Required cells are a consumer's languages in each phase; a cell without evidence fails the gate like one that isn't a pass."""
    rows = _checks(spark, d).select(F.col("source").alias("consumer"), F.col("check").alias("phase"), "lang", "result")
    required = rows.select("consumer", "phase", "lang").distinct()
    evidence = rows.filter("lang <> 'de' or phase <> 'anchors'").groupBy("consumer", "phase", "lang").agg(F.count("*").alias("cells"), F.count_if(_is("pass")).alias("passed"), F.count_if(_is("not-run")).alias("not_run"))
    none = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return required.join(evidence, ["consumer", "phase", "lang"], "left").groupBy("consumer", "phase").agg(F.count_if(F.col("cells").isNull()).alias("missing"), none("cells"), none("passed"), none("not_run"), F.bool_and(F.coalesce(F.col("cells") == F.col("passed"), F.lit(False))).alias("gate"))


@query("v13_verdict", """SELECT source, count(*) AS checks, count(*) FILTER (result = 'pass') AS passed, CASE WHEN bool_and(result = 'pass') THEN 'pass' ELSE 'fail' END AS verdict, list_sort(coalesce(list(DISTINCT "check") FILTER (result <> 'pass'), [])) AS failing,
list_sort(list(package_id) FILTER (result = 'fail'))[1:3] AS first_failures FROM pcheck GROUP BY source""".replace("list_sort(list(package_id) FILTER (result = 'fail'))", "list_sort(list(DISTINCT package_id) FILTER (result = 'fail'))"))
def v13(spark, d):
    """A source's verdict, its failing checks, and its three first failing packages (kept by rank, three a task)."""
    rows = _checks(spark, d)
    order = Window.partitionBy("source").orderBy("package_id")
    first = rows.filter(_is("fail")).select("source", "package_id").distinct().withColumn("r", F.row_number().over(order)).filter("r <= 3").groupBy("source").agg(F.sort_array(F.collect_list("package_id")).alias("first_failures"))
    verdict = rows.groupBy("source").agg(
        F.count("*").alias("checks"), F.count_if(_is("pass")).alias("passed"), F.when(F.bool_and(_is("pass")), "pass").otherwise("fail").alias("verdict"),
        F.sort_array(F.collect_set(F.when(~_is("pass"), F.col("check")))).alias("failing"),
    )
    return verdict.join(first, "source", "left")


@query("v17_corpus_acceptance", f"""SELECT source, stage, count(*) AS documents FROM (SELECT source, package_id, {_FIRST.format("passed")} AS stage FROM pcheck GROUP BY source, package_id) GROUP BY ALL""")
def v17(spark, d):
    stages = _checks(spark, d).groupBy("source", "package_id").agg(_first_failure("passed").alias("stage"))
    return stages.groupBy("source", "stage").agg(F.count("*").alias("documents"))


@query("v18_release_gate", """SELECT "check", count(*) FILTER (result = 'fail') AS real_failures, count(*) FILTER (result = 'not-run') AS blocked, bool_and(result = 'pass') AS releasable FROM pcheck GROUP BY "check" """)
def v18(spark, d):
    return _checks(spark, d).groupBy("check").agg(F.count_if(_is("fail")).alias("real_failures"), F.count_if(_is("not-run")).alias("blocked"), F.bool_and(_is("pass")).alias("releasable"))


# limits, small enough for the tables' packages

_SMALL = {"docx_package_mib": 25, "uncompressed_xml_mib": 6000 / limits.MIB, "zip_parts": 6, "max_leaf_island_bytes": 1500, "xml_nesting_depth": 8, "compression_ratio_max": 1200}
_SCALED = {name: _SMALL | {"uncompressed_xml_mib": 6000 * k / limits.MIB, "zip_parts": 7, "max_leaf_island_bytes": 1500 * k, "xml_nesting_depth": 9} for name, k in (("S", 1), ("L", 4), ("X", 8))}


def _stats(spark, d) -> DataFrame:
    packages = written(docx.damaged(_packages(spark, d), F.when(F.col("package_id") % 10 == 3, "no-zip")), "packages")
    members = docx.members(packages).filter("error is null")
    return docx.package_stats(packages).join(docx.broken_links(members), "package_id", "left").fillna(0, ["missing_targets", "cycles"])


@query("f10_resource_limits", """SELECT package_id, dimension, actual, CAST(most AS BIGINT) AS most FROM (SELECT package_id, unnest(['uncompressed-xml-bytes', 'zip-parts', 'max-leaf-island-bytes', 'max-text-node-bytes', 'xml-nesting-depth']) AS dimension,
unnest([xml, 7, most, longest, depth]) AS actual, unnest([6000, 6, 1500, 1500, 8]) AS most FROM pstat WHERE package_id % 10 <> 3) WHERE actual > most UNION ALL SELECT package_id, 'package-validity', CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM package WHERE package_id % 10 = 3""")
def f10(spark, d):
    return limits.violations(_stats(spark, d), _SMALL)


@query("v16_profile_checks", """SELECT profile, count(*) AS packages, count(*) FILTER (package_id % 10 <> 3 AND xml <= 6000 * k AND most <= 1500 * k AND longest <= 1500 * k) AS passed FROM (SELECT *, unnest(['S', 'L', 'X']) AS profile, unnest([1, 4, 8]) AS k FROM pstat) GROUP BY profile""")
def v16(spark, d):
    stats = written(_stats(spark, d), "stats")
    each = [stats.select("package_id").join(limits.violations(stats, p).select("package_id").distinct().withColumn("over", F.lit(True)), "package_id", "left").agg(F.count("*").alias("packages"), F.count_if(F.col("over").isNull()).alias("passed")).select(F.lit(name).alias("profile"), "*") for name, p in _SCALED.items()]
    return compare.problems(*each).filter("packages > 0")


# outputs of an editing session: some with another header, some without comments, some that don't open

_EDITED = """WITH s AS (SELECT package_id, package_id % 10 AS d, package_id % 3 <> 0 AS headed, any_value(coalesce(source, '')) AS source, count(*) AS n, count(*) FILTER (c = 5) AS notes, count(*) FILTER (c = 2) AS boxes, count(*) FILTER (c = 4) AS tracked, count(*) FILTER (c = 1) AS tables,
    bool_or(idx = 5) AS five, bool_or(idx = 11) AS eleven, CAST(sum(length(CASE WHEN c = 4 THEN concat(w1, w2) WHEN c = 1 THEN concat(w1, rest) ELSE text END)) AS BIGINT) AS chars FROM pline GROUP BY package_id),
o AS (SELECT *, unnest([
    {'oracle': 'byte_identical', 'observed': 2 * CAST(headed AS BIGINT) + CAST(d = 4 AS BIGINT), 'passed': NOT headed AND d <> 4}, {'oracle': 'parts_unchanged', 'observed': CAST(d = 4 AS BIGINT), 'passed': d <> 4},
    {'oracle': 'text_signature_same', 'observed': chars + CASE WHEN headed THEN 0 ELSE length(source) END, 'passed': NOT headed OR source = ''}, {'oracle': 'anchors_intact', 'observed': 2 * notes + 2 * tracked, 'passed': true},
    {'oracle': 'comments_preserved', 'observed': CASE WHEN d = 4 THEN notes ELSE 0 END, 'passed': d <> 4 OR notes = 0}, {'oracle': 'opaque_interior_unchanged', 'observed': boxes, 'passed': true},
    {'oracle': 'paragraph_count', 'observed': n + tables + boxes, 'passed': true}, {'oracle': 'paragraph_marks', 'observed': tracked, 'passed': true}, {'oracle': 'row_col_counts', 'observed': 2 * tables, 'passed': true},
    {'oracle': 'no_text_duplication', 'observed': 0, 'passed': true}, {'oracle': 'grid_span_clean', 'observed': 0, 'passed': true}, {'oracle': 'revision_count', 'observed': 2 * tracked, 'passed': true}, {'oracle': 'residual_revisions', 'observed': 2 * tracked, 'passed': tracked = 0},
    {'oracle': 'comment_present', 'observed': CASE WHEN NOT five THEN 0 WHEN d = 4 THEN 1 ELSE 2 END, 'passed': five AND d <> 4}, {'oracle': 'comment_absent', 'observed': CASE WHEN NOT eleven THEN 0 WHEN d = 4 THEN 1 ELSE 2 END, 'passed': NOT eleven}]) AS a FROM s)
SELECT package_id, a.oracle AS oracle, CASE WHEN d <> 3 THEN a.observed END AS observed, d <> 3 AND a.passed AS passed FROM o"""


@query("v9_package_oracles", _EDITED)
def v9(spark, d):
    """Assertions on outputs with another header (two of three), without comments (one of ten) or that don't open (one of ten)."""
    built = _packages(spark, d)
    headed = docx.with_header(built, F.when(F.col("package_id") % 3 != 0, "<w:hdr/>"))
    output = docx.damaged(headed, F.when(F.col("package_id") % 10 == 3, "no-zip").when(F.col("package_id") % 10 == 4, "no-comments"))
    return acceptance.assertions(built, output, ("word/header1.xml",), present="5", absent="11")


@query("v10_store_relations", """WITH o AS (SELECT sha256(type) = first_value(sha256(type)) OVER w AS same, row_number() OVER w AS r FROM review_event WINDOW w AS (PARTITION BY concat(client_id, '-', paragraph_id) ORDER BY event_id))
SELECT 'm2-revert-restores' AS relation, count(*) AS cases, count(*) AS holds FROM paragraph UNION ALL SELECT 'm8-replay-same-result', count(*), count(*) FROM o WHERE r > 1 AND same UNION ALL SELECT 'm9-changed-input-rejected', count(*), count(*) FROM o WHERE r > 1 AND NOT same
UNION ALL SELECT 'm10-noop-build-identical', count(*), count(*) FROM package UNION ALL SELECT 'm11-build-repeatable', count(*), count(*) FROM package""")
def v10(spark, d):
    """Relations of reverts, operation ledgers and builds; a pinned reader (m12) is ``r7_pinned_reader``."""
    base = b.paragraphs(spark, d).select("package_id", "idx", "text")
    drafted = base.filter("idx % 5 <> 2").withColumn("text", F.concat(F.lit("* "), "text"))  # edits, and every fifth deleted
    reverted = edits.undo(drafted, edits.record(base, drafted)).withColumnRenamed("text", "back").join(base, ["package_id", "idx"], "full_outer")
    events = b.review_events(spark, d).select("event_id", F.concat_ws("-", F.col("client_id").cast("string"), "paragraph_id").alias("operation_id"), keys.sha(F.col("type")).alias("input"))
    ledger = review.ledger(events, "operation_id", "input", "event_id")
    ran = ledger.filter("outcome = 'ran'").select("operation_id", F.col("input").alias("first"))
    again = ledger.filter("outcome <> 'ran'").join(ran, "operation_id")
    same = F.col("input") == F.col("first")
    built = _packages(spark, d)
    digest = lambda packages, name: packages.select("package_id", keys.sha(F.col("content")).alias(name))
    header = lambda changed: docx.with_header(built, F.when(F.lit(changed), "<w:hdr/>"))
    source, noop = digest(built, "x"), digest(header(False), "y")
    held = lambda rows, name, holds: rows.agg(F.count("*").alias("cases"), F.count_if(F.coalesce(holds, F.lit(False))).alias("holds")).select(F.lit(name).alias("relation"), "*")
    return compare.problems(
        held(reverted, "m2-revert-restores", F.col("back") == F.col("text")),
        held(again.filter(same), "m8-replay-same-result", F.col("outcome") == "replayed"),
        held(again.filter(~same), "m9-changed-input-rejected", F.col("outcome") == "rejected"),
        held(source.join(noop, "package_id", "full_outer"), "m10-noop-build-identical", F.col("x") == F.col("y")),
        held(digest(header(True), "x").join(digest(header(True), "y"), "package_id", "full_outer"), "m11-build-repeatable", F.col("x") == F.col("y")),
    )
