"""Joins between the document model's registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.functions import keys
from foliolake.operators import compare, ranges
from foliolake.plans.registry import query
from foliolake.sources import bindings as b

PK = ["package_id", "idx"]

_COMMENTS = """SELECT coalesce(d.id, a.id) AS id, coalesce(author, '') AS author, coalesce(text, '') AS text, coalesce(n, 0) AS anchors, coalesce(kinds, '') AS anchor_list FROM comment_def d
FULL JOIN (SELECT id, count(*) AS n, string_agg(concat(paragraph_id, ':', kind), ',' ORDER BY ordinal) AS kinds FROM comment_anchor GROUP BY id) a ON d.id = a.id"""


def comments(spark, d):
    """Definitions with their anchors; anchors without a definition stay, with empty fields."""
    rows = F.sort_array(F.collect_list(F.struct("ordinal", F.concat_ws(":", "paragraph_id", "kind").alias("at"))))
    anchored = b.comment_anchors(spark, d).groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda r: r["at"]), ",").alias("kinds"))
    both = b.comment_definitions(spark, d).join(anchored, "id", "full_outer")
    return both.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("author", "text")], F.coalesce("n", F.lit(0)).alias("anchors"), F.coalesce("kinds", F.lit("")).alias("anchor_list"))


query("j1_comment_anchors", _COMMENTS)(comments)

_RANGES = """pr AS (SELECT package_id, idx, paragraph_id AS owner, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY package_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, length(text) AS n FROM paragraph),
owner_range AS (SELECT package_id, owner, first AS start, first + n AS "end" FROM pr UNION ALL SELECT package_id, concat('B', idx, '.P0'), first + 10, first + 30 FROM pr WHERE n >= 40),
point AS (SELECT r.package_id, r.w_id, pr.first + r.start AS position FROM revision_row r JOIN pr USING (package_id, idx))"""


def owner_ranges(spark, d):
    """Paragraphs as ranges of their package's text, and a box inside each long one."""
    from pyspark.sql import Window

    order = Window.partitionBy("package_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0))
    placed = b.paragraphs(spark, d).select("package_id", "idx", "paragraph_id", first.alias("first"), F.length("text").alias("n"))
    body = F.struct(F.col("paragraph_id").alias("owner"), F.col("first").alias("start"), (F.col("first") + F.col("n")).alias("end"))
    box = F.struct(F.concat(F.lit("B"), F.col("idx"), F.lit(".P0")).alias("owner"), (F.col("first") + 10).alias("start"), (F.col("first") + 30).alias("end"))
    both = F.explode(F.array_compact(F.array(body, F.when(F.col("n") >= 40, box)))).alias("o")
    return placed, placed.select("package_id", both).select("package_id", "o.*")


def _points(spark, d, placed):
    rows = b.revisions(spark, d).select("package_id", "idx", "w_id", "start")
    return rows.join(placed.select("package_id", "idx", "first"), PK).select("package_id", "w_id", (F.col("first") + F.col("start")).alias("position"))


@query("j2_innermost_owner", f"""WITH {_RANGES} SELECT p.package_id, w_id, position, arg_max(owner, start) AS owner FROM point p JOIN owner_range o ON p.package_id = o.package_id AND start <= position AND position < "end" GROUP BY ALL""")
def j2(spark, d):
    placed, owners = owner_ranges(spark, d)
    found = ranges.containing(_points(spark, d, placed), owners, ["package_id"])
    return found.groupBy("package_id", "w_id", "position").agg(F.max_by("owner", "start").alias("owner"))


@query("j3_first_owner", f"""WITH {_RANGES} SELECT p.package_id, w_id, position, arg_min(owner, start) AS owner FROM point p JOIN owner_range o ON p.package_id = o.package_id AND start <= position AND position < "end" GROUP BY ALL""")
def j3(spark, d):
    placed, owners = owner_ranges(spark, d)
    found = ranges.containing(_points(spark, d, placed), owners, ["package_id"])
    return found.groupBy("package_id", "w_id", "position").agg(F.min_by("owner", "start").alias("owner"))


@query("j4_paragraphs_with_opaque", "SELECT package_id, idx, paragraph_id FROM paragraph p WHERE EXISTS (SELECT 1 FROM leaf l WHERE l.package_id = p.package_id AND l.idx = p.idx AND regexp_matches(l.text, '[0-9]'))")
def j4(spark, d):
    opaque = b.leaves(spark, d).filter(F.col("text").rlike("[0-9]")).select(*PK)
    return b.paragraphs(spark, d).join(opaque, PK, "left_semi").select(*PK, "paragraph_id")


@query("j5_segment_revision", """WITH s AS MATERIALIZED (SELECT package_id, idx, k, start, "end", revision FROM segment), r AS MATERIALIZED (SELECT * FROM s WHERE revision IS NOT NULL)
SELECT s.package_id, s.idx, s.k, r.revision FROM r JOIN s ON s.package_id = r.package_id AND s.idx = r.idx AND s.k = r.k WHERE s.start = r.start AND s."end" = r."end" """)
def j5(spark, d):
    rows = b.revisions(spark, d).select(*PK, "k", "start", "end", "revision")
    return b.segments(spark, d).select(*PK, "k", "start", "end").join(rows, [*PK, "k", "start", "end"]).select(*PK, "k", "revision")


@query("j6_open_comments", """WITH c AS (SELECT package_id, idx, unnest(['c1', 'c2']) AS comment, unnest([10, 30]) AS os, unnest([50, 80]) AS oe FROM paragraph WHERE length(text) > 80)
SELECT s.package_id, s.idx, s.k, list_sort(list(comment)) AS comments FROM leaf s JOIN c ON s.package_id = c.package_id AND s.idx = c.idx AND s.start < oe AND os < s."end" GROUP BY ALL""")
def j6(spark, d):
    at = F.explode(F.array(F.struct(F.lit("c1").alias("comment"), F.lit(10).alias("s"), F.lit(50).alias("e")), F.struct(F.lit("c2").alias("comment"), F.lit(30).alias("s"), F.lit(80).alias("e"))))
    noted = b.paragraphs(spark, d).filter(F.length("text") > 80).select(*PK, at.alias("c")).select(*PK, "c.comment", F.col("c.s").alias("other_start"), F.col("c.e").alias("other_end"))
    found = ranges.overlapping(b.leaves(spark, d).filter("end > start").select(*PK, "k", "start", "end"), noted, PK)
    return found.groupBy(*PK, "k").agg(F.sort_array(F.collect_list("comment")).alias("comments"))


@query("j7_region_coverage", """SELECT package_id, idx, count(*) AS segments, CAST(min(start) AS BIGINT) AS first, CAST(max("end") AS BIGINT) AS last, min(start) <= 5 AND max("end") >= 25 AS covered FROM leaf WHERE start < 25 AND 5 < "end" GROUP BY ALL""")
def j7(spark, d):
    inside = b.leaves(spark, d).filter("start < 25 and 5 < end")
    return inside.groupBy(*PK).agg(F.count("*").alias("segments"), F.min("start").alias("first"), F.max("end").alias("last"), ((F.min("start") <= 5) & (F.max("end") >= 25)).alias("covered"))


@query("j8_catalog_hits", "SELECT source, target, classification, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[äöüßéèêçñóíá]')) AS source FROM package) JOIN catalog USING (source) GROUP BY ALL")
def j8(spark, d):
    chars = b.packages(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("[äöüßéèêçñóíá]"), 0)).alias("source"))
    return chars.join(F.broadcast(b.catalog(spark)), "source").groupBy("source", "target", "classification").agg(F.count("*").alias("n"))


@query("j9_pending_decisions", "SELECT p.package_id, decision, decision IS NULL AS pending FROM package p LEFT JOIN decision d ON p.package_id = d.package_id")
def j9(spark, d):
    return b.packages(spark, d).select("package_id").join(b.decisions(spark, d), "package_id", "left").select("package_id", "decision", F.col("decision").isNull().alias("pending"))


@query("j10_unknown_occurrences", "SELECT package_id FROM decision WHERE package_id NOT IN (SELECT package_id FROM package WHERE regexp_matches(text, '[äöüßéèêçñóíá]'))")
def j10(spark, d):
    known = b.packages(spark, d).filter(F.col("text").rlike("[äöüßéèêçñóíá]")).select("package_id")
    return b.decisions(spark, d).join(known, "package_id", "left_anti").select("package_id")


OUTPUT = """output AS (SELECT package_id, CASE WHEN package_id % 10 = 0 THEN sha256(concat(text, '!')) ELSE source_sha256 END AS source_sha256 FROM package WHERE package_id % 13 <> 0
UNION ALL SELECT package_id + 1000000000, source_sha256 FROM package WHERE package_id % 17 = 0)"""


def output_manifest(spark, d):
    """A deterministic output beside the template: some parts changed, some gone, some new."""
    rows = b.packages(spark, d)
    digest = F.when(F.col("package_id") % 10 == 0, keys.sha(F.concat("text", F.lit("!")))).otherwise(F.col("source_sha256"))
    kept = rows.filter("package_id % 13 <> 0").select("package_id", digest.alias("source_sha256"))
    return kept.unionByName(rows.filter("package_id % 17 = 0").select((F.col("package_id") + 1_000_000_000).alias("package_id"), "source_sha256"))


_DIFF = f"""WITH {OUTPUT} SELECT coalesce(p.package_id, o.package_id) AS package_id, CASE WHEN p.package_id IS NULL THEN 'added' WHEN o.package_id IS NULL THEN 'removed' WHEN p.source_sha256 <> o.source_sha256 THEN 'changed' ELSE 'same' END AS status
FROM package p FULL JOIN output o ON p.package_id = o.package_id"""


@query("j11_manifest_diff", _DIFF)
def j11(spark, d):
    return compare.manifest_diff(b.packages(spark, d), output_manifest(spark, d), "package_id", "source_sha256")


@query("j12_changed_paragraphs", "SELECT package_id, idx FROM (SELECT *, CASE WHEN idx % 5 = 0 THEN upper(text) ELSE text END AS draft FROM paragraph) WHERE draft IS DISTINCT FROM text")
def j12(spark, d):
    draft = b.paragraphs(spark, d).select(*PK, F.when(F.col("idx") % 5 == 0, F.upper("text")).otherwise(F.col("text")).alias("draft"))
    both = b.paragraphs(spark, d).select(*PK, "text").join(draft, PK, "left")
    return both.filter(~F.coalesce("draft", F.lit("")).eqNullSafe(F.coalesce("text", F.lit("")))).select(*PK)


@query("j13_wanted_events", "SELECT event_id, client_id FROM review_event WHERE client_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def j13(spark, d):
    wanted = b.read(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("client_id"))
    return b.review_events(spark, d).join(wanted, "client_id", "left_semi").select("event_id", "client_id")


_LATEST = """SELECT client_id, event_id, status, paragraph_id, first_created_at, versions FROM (SELECT *, min(created_at) OVER (PARTITION BY client_id) AS first_created_at, count(*) OVER (PARTITION BY client_id) AS versions,
row_number() OVER (PARTITION BY client_id ORDER BY created_at DESC, event_id DESC) AS r FROM review_event) WHERE r = 1"""


@query("j14_draft_upsert", _LATEST)
def j14(spark, d):
    return compare.latest(b.review_events(spark, d), "client_id", ("created_at", "event_id")).select("client_id", "event_id", "status", "paragraph_id", "first_created_at", "versions")


@query("j15_claimed_fingerprints", """WITH claim AS (SELECT package_id, left(sha256(CASE WHEN package_id % 7 = 0 THEN concat(text, '?') ELSE text END), 12) AS claimed FROM package WHERE package_id % 19 <> 0)
SELECT p.package_id, CASE WHEN claimed IS NULL THEN 'missing' WHEN claimed <> left(sha256(text), 12) THEN 'mismatch' ELSE 'match' END AS status FROM package p LEFT JOIN claim c ON p.package_id = c.package_id""")
def j15(spark, d):
    rows = b.packages(spark, d)
    claim = F.when(F.col("package_id") % 7 == 0, keys.fingerprint12(F.concat("text", F.lit("?")))).otherwise(keys.fingerprint12(F.col("text")))
    claimed = rows.filter("package_id % 19 <> 0").select("package_id", claim.alias("claimed"))
    both = rows.select("package_id", keys.fingerprint12(F.col("text")).alias("found")).join(claimed, "package_id", "left")
    return both.select("package_id", F.when(F.col("claimed").isNull(), "missing").when(F.col("claimed") != F.col("found"), "mismatch").otherwise("match").alias("status"))


@query("j16_relationship_cycles", """WITH e AS MATERIALIZED (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), n AS (SELECT DISTINCT a FROM e WHERE a % 11 <> 0)
SELECT e.a, e.b, f.a IS NOT NULL AS two_cycle, n.a IS NULL AS missing_target FROM e LEFT JOIN e f ON f.a = e.b AND f.b = e.a LEFT JOIN n ON n.a = e.b""")
def j16(spark, d):
    """Relationships of parts to suppliers: those that lead back, and those whose target isn't there."""
    edges = b.read(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    nodes = edges.filter("a % 11 <> 0").select(F.col("a").alias("b")).distinct().withColumn("there", F.lit(True))
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("back"))
    both = edges.join(back, ["a", "b"], "left").join(nodes, "b", "left")
    return both.select("a", "b", F.col("back").isNotNull().alias("two_cycle"), F.col("there").isNull().alias("missing_target"))


@query("j17_missing_cells", """SELECT n_name AS consumer, phase, r_name AS fixture FROM nation, (SELECT unnest(['open', 'edit', 'save']) AS phase), region
WHERE NOT EXISTS (SELECT 1 FROM customer JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE n2.n_name = nation.n_name AND n2.n_regionkey = r_regionkey AND CASE c_custkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'edit' ELSE 'other' END = phase)""")
def j17(spark, d):
    # the required matrix is three short lists; each row of one gets the other two as arrays
    fixtures = b.read(spark, d, "region").select(F.sort_array(F.collect_set("r_name")).alias("fixtures"), F.lit(1).alias("one"))
    consumers = b.read(spark, d, "nation").select(F.col("n_name").alias("consumer"), F.lit(1).alias("one")).join(F.broadcast(fixtures), "one")
    phases = F.explode(F.array(*[F.lit(p) for p in ("open", "edit", "save")]))
    required = consumers.select("consumer", "fixtures", phases.alias("phase")).select("consumer", "phase", F.explode("fixtures").alias("fixture"))
    at = b.read(spark, d, "customer").join(b.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(b.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    phase = F.when(F.col("c_custkey") % 4 == 0, "open").when(F.col("c_custkey") % 4 == 1, "edit").otherwise("other")
    evidence = at.select(F.col("n_name").alias("consumer"), phase.alias("phase"), F.col("r_name").alias("fixture")).distinct()
    return required.join(evidence, ["consumer", "phase", "fixture"], "left_anti")


@query("j18_registry_audit", """SELECT 'order-without-customer' AS check, CAST(o_custkey AS VARCHAR) AS key FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'item-without-order', CAST(l_orderkey AS VARCHAR) FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'order-without-item', CAST(o_orderkey AS VARCHAR) FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
UNION ALL SELECT 'label-without-document', CAST(doc_id AS VARCHAR) FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
UNION ALL SELECT 'repeated-part-name', p_name FROM part GROUP BY p_name HAVING count(*) > 1""")
def j18(spark, d):
    t = lambda name: b.read(spark, d, name)
    return compare.problems(
        compare.without_parent(t("orders"), t("customer"), "o_custkey", "c_custkey", "order-without-customer"),
        compare.without_parent(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey", "item-without-order"),
        compare.without_parent(t("orders"), t("lineitem"), "o_orderkey", "l_orderkey", "order-without-item"),
        compare.without_parent(t("labels"), t("documents"), "doc_id", "doc_id", "label-without-document"),
        compare.repeated(t("part"), "p_name", "repeated-part-name"),
    )


@query("j19_plan_coverage", """SELECT coalesce(o_orderkey, k) AS check_id, CASE WHEN k IS NULL THEN 'missing' WHEN o_orderkey IS NULL THEN 'extra' WHEN n > 5 THEN 'duplicate' ELSE 'covered' END AS status
FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 4) FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = k""")
def j19(spark, d):
    plan = b.read(spark, d, "orders").filter("o_orderkey % 9 <> 4").select(F.col("o_orderkey").alias("check_id"), F.lit(True).alias("planned"))
    report = b.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("check_id")).agg(F.count("*").alias("n"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("planned").isNull(), "extra").when(F.col("n") > 5, "duplicate").otherwise("covered")
    return plan.join(report, "check_id", "full_outer").select("check_id", status.alias("status"))


@query("j20_inherited_attributes", """WITH t AS (SELECT package_id, idx, paragraph_id, length(text) AS width FROM paragraph) SELECT n.package_id, n.idx, t.paragraph_id AS inherits, t.width, CASE WHEN t.paragraph_id IS NULL THEN 'unknown-template' END AS code
FROM (SELECT package_id, idx, idx + (idx % 3) - 1 AS wanted FROM paragraph WHERE idx % 4 = 1) n LEFT JOIN t ON n.package_id = t.package_id AND n.wanted = t.idx""")
def j20(spark, d):
    rows = b.paragraphs(spark, d)
    template = rows.select("package_id", F.col("idx").alias("wanted"), F.col("paragraph_id").alias("inherits"), F.length("text").cast("long").alias("width"))
    new = rows.filter("idx % 4 = 1").select(*PK, (F.col("idx") + F.col("idx") % 3 - 1).alias("wanted"))
    return new.join(template, ["package_id", "wanted"], "left").select(*PK, "inherits", "width", F.when(F.col("inherits").isNull(), "unknown-template").alias("code"))


@query("j21_history_generations", "SELECT event_id, client_id, workdir, ordinal FROM review_event LEFT JOIN generation_row ON event_id = generation")
def j21(spark, d):
    made = b.generations(spark, d).select(F.col("generation").alias("event_id"), "workdir", "ordinal")
    return b.review_events(spark, d).select("event_id", "client_id").join(made, "event_id", "left")


@query("j22_hyperlink_targets", """WITH a AS (SELECT page_id AS package_id, unnest(m) AS m, generate_subscripts(m, 1) - 1 AS ordinal FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS m FROM pages))
SELECT a.package_id, regexp_extract(m, '>([^<]*)<', 1) AS text, rel_id, target FROM a JOIN relationship r ON a.package_id = r.package_id AND a.ordinal = r.ordinal""")
def j22(spark, d):
    anchors = b.read(spark, d, "pages").select(F.col("page_id").alias("package_id"), F.posexplode(F.regexp_extract_all("html", F.lit('<a href="[^"]*">[^<]*</a>'), 0)).alias("ordinal", "m"))
    return anchors.join(b.relationships(spark, d), ["package_id", "ordinal"]).select("package_id", F.regexp_extract("m", ">([^<]*)<", 1).alias("text"), "rel_id", "target")


@query("j23_stale_decisions", """WITH r AS MATERIALIZED (SELECT package_id, CAST(idx * 1000 + k AS VARCHAR) AS w_id, k, left(sha256(text), 12) AS found FROM (SELECT package_id, idx, unnest(words) AS text, generate_subscripts(words, 1) - 1 AS k FROM (SELECT package_id, idx, string_split(text, ' ') AS words FROM paragraph)) WHERE k % 11 IN (3, 7) OR k % 29 IN (5, 9)),
decided AS (SELECT package_id, w_id AS "of", CASE WHEN k % 5 = 0 THEN concat('x', w_id) ELSE w_id END AS w_id, CASE WHEN k % 4 = 0 THEN '000000000000' ELSE found END AS claimed FROM r)
SELECT d.package_id, "of" AS w_id, CASE WHEN found IS NULL THEN 'unknown-revision' WHEN found <> claimed THEN 'fingerprint-mismatch' ELSE 'current' END AS status FROM decided d LEFT JOIN r ON d.package_id = r.package_id AND d.w_id = r.w_id""")
def j23(spark, d):
    rows = b.revisions(spark, d)
    claimed = F.when(F.col("k") % 4 == 0, F.lit("000000000000")).otherwise(keys.fingerprint12(F.col("text")))
    wanted = F.when(F.col("k") % 5 == 0, F.concat(F.lit("x"), F.col("w_id"))).otherwise(F.col("w_id"))
    decided = rows.select("package_id", F.col("w_id").alias("of"), wanted.alias("w_id"), claimed.alias("claimed"))
    current = rows.select("package_id", "w_id", keys.fingerprint12(F.col("text")).alias("found"))
    status = F.when(F.col("found").isNull(), "unknown-revision").when(F.col("found") != F.col("claimed"), "fingerprint-mismatch").otherwise("current")
    return decided.join(current, ["package_id", "w_id"], "left").select("package_id", F.col("of").alias("w_id"), status.alias("status"))
