"""Sources, inventories, views, styles, digests and windows over packages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliolake.functions import keys, text
from foliolake.operators import inventory as op
from foliolake.plans.registry import query
from foliolake.sources import bindings as b

PK = ["package_id", "idx"]


@query("s3_tag_stream", "SELECT package_id, idx, name, closing, void FROM tag")
def s3(spark, d):
    return b.tags(spark, d).select("package_id", "idx", "name", "closing", "void")


@query("s7_prose_inventory", "SELECT package_id, idx, paragraph_id, count(*) AS leaf_count, count(*) FILTER (regexp_matches(text, '[0-9]')) AS opaque_count, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (regexp_matches(text, '[0-9]')) = 0 AS editable FROM leaf GROUP BY ALL")
def s7(spark, d):
    return op.paragraph_inventory(b.leaves(spark, d))


@query("s8_projection", 'SELECT package_id, idx, paragraph_id, k, start, "end", text, style_id, revision, in_original, in_final FROM segment')
def s8(spark, d):
    return b.segments(spark, d).select(*PK, "paragraph_id", "k", "start", "end", "text", "style_id", "revision", "in_original", "in_final")


@query("f1_editable_segments", "SELECT package_id, idx, k FROM segment WHERE NOT coalesce(kind IN ('delete', 'move_from'), false) AND NOT regexp_matches(text, '[0-9]')")
def f1(spark, d):
    return b.segments(spark, d).filter(~F.coalesce(F.col("kind").isin("delete", "move_from"), F.lit(False)) & ~F.col("text").rlike("[0-9]")).select(*PK, "k")


@query("f3_element_classes", "SELECT package_id, CASE WHEN name IN ('p', 'h1', 'li') THEN 'paragraph' WHEN name IN ('b', 'a') THEN 'run' WHEN name IN ('nav', 'div', 'article', 'footer', 'ul') THEN 'container' ELSE 'unknown' END AS class, count(*) AS n FROM tag WHERE NOT closing GROUP BY ALL")
def f3(spark, d):
    name = F.col("name")
    kind = F.when(name.isin("p", "h1", "li"), "paragraph").when(name.isin("b", "a"), "run").when(name.isin("nav", "div", "article", "footer", "ul"), "container").otherwise("unknown")
    return b.tags(spark, d).filter(~F.col("closing")).groupBy("package_id", kind.alias("class")).agg(F.count("*").alias("n"))


_LOCKS = """WITH marked AS (SELECT package_id, idx, bool_or(regexp_matches(text, '[0-9]')) AS opaque FROM leaf GROUP BY ALL)
SELECT package_id, r.idx, w_id, reason, reason IS NULL AS editable, CASE WHEN reason = 'paragraph-mark-revision' THEN 'paragraph-mark' END AS scope FROM (SELECT r.*, CASE WHEN text = '' THEN 'paragraph-mark-revision'
WHEN regexp_matches(text, '[0-9]') THEN 'nested-container-or-non-editable-part' WHEN opaque THEN 'paragraph-contains-unsupported-node' END AS reason FROM revision_row r JOIN marked USING (package_id, idx)) r"""


@query("f4_revision_locks", _LOCKS)
def f4(spark, d):
    opaque = b.leaves(spark, d).groupBy(*PK).agg(F.bool_or(F.col("text").rlike("[0-9]")).alias("opaque"))
    reason = F.when(F.col("text") == "", "paragraph-mark-revision").when(F.col("text").rlike("[0-9]"), "nested-container-or-non-editable-part").when(F.col("opaque"), "paragraph-contains-unsupported-node")
    rows = b.revisions(spark, d).join(opaque, PK).withColumn("reason", reason)
    return rows.select(*PK, "w_id", "reason", F.col("reason").isNull().alias("editable"), F.when(F.col("reason") == "paragraph-mark-revision", "paragraph-mark").alias("scope"))


@query("f5_point_lookup", "SELECT package_id, paragraph_id, text FROM paragraph WHERE package_id = 7 AND paragraph_id = 'P0'")
def f5(spark, d):
    return b.paragraphs(spark, d).filter("package_id = 7 and paragraph_id = 'P0'").select("package_id", "paragraph_id", "text")


@query("f9_volatile_stripped", "SELECT package_id, sha256(regexp_replace(text, '[0-9]+', '', 'g')) AS stable_sha256 FROM package")
def f9(spark, d):
    return b.packages(spark, d).select("package_id", keys.sha(F.regexp_replace("text", "[0-9]+", "")).alias("stable_sha256"))


@query("a1_canonical_text", "SELECT package_id, idx, string_agg(text, ' ' ORDER BY k) AS text FROM leaf GROUP BY ALL")
def a1(spark, d):
    return b.leaves(spark, d).groupBy(*PK).agg(op.ordered_text().alias("text"))


@query("a2_text_views", "SELECT package_id, idx, coalesce(string_agg(text, ' ' ORDER BY k) FILTER (in_original), '') AS original, string_agg(text, ' ' ORDER BY k) AS tracked, coalesce(string_agg(text, ' ' ORDER BY k) FILTER (in_final), '') AS final FROM segment GROUP BY ALL")
def a2(spark, d):
    return op.views(b.segments(spark, d))


@query("a3_leaf_counts", "SELECT package_id, count(*) AS leaves, count(*) FILTER (regexp_matches(text, '[0-9]')) AS opaque FROM leaf GROUP BY ALL")
def a3(spark, d):
    return b.leaves(spark, d).groupBy("package_id").agg(F.count("*").alias("leaves"), F.count_if(F.col("text").rlike("[0-9]")).alias("opaque"))


@query("a4_visible_chars", "SELECT package_id, CAST(sum(CASE WHEN in_final THEN length(text) ELSE 0 END) AS BIGINT) AS final_chars, CAST(sum(CASE WHEN in_original THEN length(text) ELSE 0 END) AS BIGINT) AS original_chars FROM segment GROUP BY ALL")
def a4(spark, d):
    chars = lambda c: F.sum(F.when(F.col(c), F.length("text")).otherwise(0))
    return b.segments(spark, d).groupBy("package_id").agg(chars("in_final").alias("final_chars"), chars("in_original").alias("original_chars"))


@query("a5_base_style", """WITH w AS (SELECT package_id, idx, style_id, CAST(sum(length(text)) AS BIGINT) AS chars, min(k) AS f FROM segment WHERE in_final GROUP BY ALL)
SELECT package_id, idx, style_id AS base_style, chars FROM (SELECT *, row_number() OVER (PARTITION BY package_id, idx ORDER BY chars DESC, f) AS r FROM w) WHERE r = 1""")
def a5(spark, d):
    return op.base_style(b.segments(spark, d))


@query("a9_package_stats", """SELECT package_id, max(length(interior)) AS longest, CAST(sum(length(interior)) AS BIGINT) AS total, count(*) AS entries, count(*) - count(DISTINCT interior) AS duplicates FROM opaque GROUP BY ALL""")
def a9(spark, d):
    size = F.length("interior")
    return b.opaque_blocks(spark, d).groupBy("package_id").agg(F.max(size).cast("long").alias("longest"), F.sum(size).alias("total"), F.count("*").alias("entries"), (F.count("*") - F.count_distinct("interior")).alias("duplicates"))


@query("a10_next_revision_id", """WITH ids AS (SELECT DISTINCT package_id, k AS v FROM segment WHERE kind IS NOT NULL OR k < 3), cand AS (SELECT package_id, v + 1 AS v FROM ids UNION SELECT package_id, 0 FROM ids)
SELECT package_id, CAST(min(v) AS BIGINT) AS next_id FROM cand WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.package_id = cand.package_id AND ids.v = cand.v) GROUP BY package_id""")
def a10(spark, d):
    taken = b.segments(spark, d).filter("kind is not null or k < 3").select("package_id", F.col("k").cast("long").alias("k"))
    return op.missing_least(taken, "package_id", "k")


@query("a11_max_revision_id", "SELECT package_id, max(TRY_CAST(w_id AS BIGINT)) AS max_id FROM segment WHERE w_id IS NOT NULL GROUP BY ALL")
def a11(spark, d):
    return b.segments(spark, d).filter("w_id is not null").groupBy("package_id").agg(F.max(F.expr("try_cast(w_id as bigint)")).alias("max_id"))


@query("a17_source_snapshot", "SELECT lang, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM package GROUP BY lang")
def a17(spark, d):
    return b.packages(spark, d).groupBy("lang").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


@query("a18_inventory_digest", """SELECT source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
sha256(concat(count(*), ':', sum(CAST(concat('0x', left(sha256(concat(package_id, ':', source_sha256)), 15)) AS HUGEINT)))) AS inventory_sha256 FROM package GROUP BY source""")
def a18(spark, d):
    return op.manifest_digest(b.packages(spark, d), "source")


@query("a19_paragraph_fingerprint", """SELECT package_id, idx, sha256(CAST(to_json({'segments': list({'end': "end", 'revision': revision, 'start': start, 'style_id': style_id, 'text': text} ORDER BY k)}) AS VARCHAR)) AS fingerprint FROM segment GROUP BY ALL""")
def a19(spark, d):
    return op.fingerprints(b.segments(spark, d))


@query("a20_skeleton", "SELECT package_id, string_agg(concat(CASE WHEN closing THEN '/' ELSE '' END, name), '>' ORDER BY idx) AS skeleton FROM tag GROUP BY ALL")
def a20(spark, d):
    token = F.concat(F.when(F.col("closing"), "/").otherwise(""), "name").alias("token")
    rows = F.sort_array(F.collect_list(F.struct("idx", token)))
    return b.tags(spark, d).groupBy("package_id").agg(F.array_join(F.transform(rows, lambda r: r["token"]), ">").alias("skeleton"))


@query("a23_text_count", "SELECT lang, CAST(sum((length(text) - length(replace(text, 'en', ''))) // 2) AS BIGINT) AS n FROM package GROUP BY lang")
def a23(spark, d):
    return b.packages(spark, d).groupBy("lang").agg(F.sum(text.occurrences(F.col("text"), "en")).alias("n"))


@query("a25_duplicate_texts", "SELECT source_sha256, count(*) AS n, min(package_id) AS first_id FROM package GROUP BY source_sha256 HAVING count(*) > 1")
def a25(spark, d):
    return b.packages(spark, d).groupBy("source_sha256").agg(F.count("*").alias("n"), F.min("package_id").alias("first_id")).filter("n > 1")


@query("a26_distinct_styles", "SELECT package_id, list_sort(list(DISTINCT style_id)) AS styles FROM segment GROUP BY ALL")
def a26(spark, d):
    return b.segments(spark, d).groupBy("package_id").agg(F.sort_array(F.collect_set("style_id")).alias("styles"))


@query("w1_segment_offsets", 'SELECT package_id, idx, k, start, "end" FROM leaf')
def w1(spark, d):
    return b.leaves(spark, d).select(*PK, "k", "start", "end")


@query("w2_ordinals", "SELECT package_id, idx, name, row_number() OVER (PARTITION BY package_id, name ORDER BY idx) - 1 AS ordinal FROM tag WHERE NOT closing")
def w2(spark, d):
    order = Window.partitionBy("package_id", "name").orderBy("idx")
    return b.tags(spark, d).filter(~F.col("closing")).select(*PK, "name", (F.row_number().over(order) - 1).alias("ordinal"))


@query("w3_nesting_depth", "SELECT package_id, CAST(max(depth) AS BIGINT) AS max_depth, CAST(min(depth) AS BIGINT) AS min_depth FROM (SELECT package_id, sum(CASE WHEN void THEN 0 WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY package_id ORDER BY idx) AS depth FROM tag) GROUP BY package_id")
def w3(spark, d):
    return op.nesting(b.tags(spark, d)).groupBy("package_id").agg(F.max("depth").alias("max_depth"), F.min("depth").alias("min_depth"))


@query("w4_revision_ancestry", """SELECT l.package_id, l.idx, l.k, arg_max(key, first) AS innermost, count(*) AS depth, NOT bool_or(kind = 'insert') AS in_original, NOT bool_or(kind = 'delete') AS in_final
FROM leaf l JOIN nested n ON l.package_id = n.package_id AND l.idx = n.idx AND n.first <= l.k AND l.k < n.last GROUP BY ALL""")
def w4(spark, d):
    return op.ancestry(b.leaves(spark, d), b.nested_revisions(spark, d))


@query("w6_merged_runs", """WITH s AS (SELECT package_id, idx, k, text, start, "end", concat_ws('/', style_id, kind) AS state FROM segment),
m AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY package_id, idx ORDER BY k) IS NOT DISTINCT FROM state THEN 0 ELSE 1 END AS new FROM s),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY package_id, idx ORDER BY k) - 1 AS BIGINT) AS run FROM m)
SELECT package_id, idx, run, state, min(start) AS start, max("end") AS "end", count(*) AS leaves, string_agg(text, ' ' ORDER BY k) AS text FROM r GROUP BY package_id, idx, run, state""")
def w6(spark, d):
    return op.merge_runs(b.segments(spark, d))


@query("w12_neighbour_styles", """WITH n AS (SELECT *, last_value(CASE WHEN kind IS DISTINCT FROM 'insert' THEN {'s': style_id, 't': text} END IGNORE NULLS) OVER (PARTITION BY package_id, idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
first_value(CASE WHEN kind IS DISTINCT FROM 'insert' THEN {'s': style_id, 't': text} END IGNORE NULLS) OVER (PARTITION BY package_id, idx ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM segment),
f AS (SELECT *, (l IS NULL AND r IS NULL) OR coalesce(l.t = r.t AND l.s <> r.s, false) AS refused FROM n WHERE kind = 'insert')
SELECT package_id, idx, k, l.s AS left_style, r.s AS right_style, CASE WHEN NOT refused THEN CASE WHEN k = 0 THEN coalesce(r.s, l.s) ELSE coalesce(l.s, r.s) END END AS taken_style, refused FROM f""")
def w12(spark, d):
    return op.neighbour_styles(b.segments(spark, d))


@query("o2_extract_order", "SELECT package_id, name, row_number() OVER (PARTITION BY package_id ORDER BY CASE name WHEN 'head' THEN 0 WHEN 'article' THEN 1 WHEN 'footer' THEN 2 ELSE 3 END, name) AS rank FROM (SELECT DISTINCT package_id, name FROM tag)")
def o2(spark, d):
    part = F.when(F.col("name") == "head", 0).when(F.col("name") == "article", 1).when(F.col("name") == "footer", 2).otherwise(3)
    order = Window.partitionBy("package_id").orderBy(part, "name")
    return b.tags(spark, d).select("package_id", "name").distinct().withColumn("rank", F.row_number().over(order))


@query("o4_truncated_report", "SELECT source, list_transform(list_sort(list(text))[1:5], lambda x: left(x, 60)) AS first_lines FROM (SELECT source, left(text, 160) AS text FROM package) GROUP BY source")
def o4(spark, d):
    # Spark keeps five rows of a group in each task before the shuffle, so no group meets whole
    order = Window.partitionBy("source").orderBy("text")
    least = b.packages(spark, d).select("source", F.left("text", F.lit(160)).alias("text")).withColumn("r", F.row_number().over(order)).filter("r <= 5")
    return least.groupBy("source").agg(F.transform(F.sort_array(F.collect_list("text")), lambda x: F.left(x, F.lit(60))).alias("first_lines"))


@query("x1_digests", "SELECT package_id, sha256(text) AS sha256, sha256(concat('{\"lang\":\"', lang, '\",\"source\":\"', source, '\"}')) AS json_sha256 FROM package")
def x1(spark, d):
    fields = keys.canonical_json({"source": F.col("source"), "lang": F.col("lang")})
    return b.packages(spark, d).select("package_id", keys.sha(F.col("text")).alias("sha256"), keys.sha(fields).alias("json_sha256"))


@query("x2_revision_keys", "SELECT package_id, revision, split_part(revision, '|', 1) AS part, split_part(revision, '|', 2) AS kind, split_part(revision, '|', 3) AS w_id, split_part(revision, '|', 4) AS fingerprint FROM revision_row")
def x2(spark, d):
    return b.revisions(spark, d).select("package_id", "revision", *keys.parse_revision_key(F.col("revision")))


_ESC = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


_UNESC = f"replace(replace(replace(replace(replace({_ESC}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')"


@query("x3_xml_escape", f"SELECT package_id, sha256({_ESC}) AS escaped_sha256, CAST(length({_ESC}) AS BIGINT) AS escaped_chars, {_UNESC} = text AS round_trip FROM package")
def x3(spark, d):
    escaped = b.packages(spark, d).withColumn("e", text.xml_escape(F.col("text")))
    return escaped.select("package_id", keys.sha(F.col("e")).alias("escaped_sha256"), F.length("e").cast("long").alias("escaped_chars"), (text.xml_unescape(F.col("e")) == F.col("text")).alias("round_trip"))


@query("x4_attribute_values", """SELECT page_id AS package_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, 'charset="([^"]*)"', 1) AS charset FROM pages""")
def x4(spark, d):
    return b.read(spark, d, "pages").select(F.col("page_id").alias("package_id"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), F.regexp_extract("html", 'charset="([^"]*)"', 1).alias("charset"))


@query("x5_leaf_paths", "SELECT package_id, concat(paragraph_id, '.', k) AS path, CAST(regexp_extract(paragraph_id, '^P([0-9]+)$', 1) AS BIGINT) AS paragraph, k AS leaf FROM leaf")
def x5(spark, d):
    rows = b.leaves(spark, d).select("package_id", F.concat("paragraph_id", F.lit("."), F.col("k").cast("string")).alias("path"))
    field = lambda i: F.regexp_extract("path", r"^P([0-9]+)\.([0-9]+)$", i).cast("long")
    return rows.select("*", field(1).alias("paragraph"), field(2).alias("leaf"))


@query("x6_codepoints", "SELECT codepoint, count(*) AS n, count(DISTINCT package_id) AS packages FROM (SELECT package_id, printf('U+%04X', unicode(u)) AS codepoint FROM (SELECT package_id, unnest(string_split(text, '')) AS u FROM package WHERE text <> '')) GROUP BY codepoint")
def x6(spark, d):
    """Every character of every text, counted by code point; a text's characters are counted before anything is dealt."""
    chars = b.packages(spark, d).filter("text <> ''").select("package_id", F.explode(F.split("text", "")).alias("char"))
    counted = chars.groupBy("package_id", "char").agg(F.count("*").alias("n"))
    return counted.groupBy(text.codepoint(F.col("char")).alias("codepoint")).agg(F.sum("n").alias("n"), F.count("*").alias("packages"))


@query("x7_clamped_range", "SELECT package_id, substring(text, 11, 30) AS part FROM package")
def x7(spark, d):
    return b.packages(spark, d).select("package_id", text.sub(F.col("text"), F.lit(10), F.lit(40)).alias("part"))


@query("x8_occurrences", "SELECT package_id, CAST(strpos(text, 'er') AS BIGINT) - 1 AS first, CAST((length(text) - length(replace(text, 'er', ''))) // 2 AS BIGINT) AS n FROM package")
def x8(spark, d):
    return b.packages(spark, d).select("package_id", (F.instr("text", "er") - 1).cast("long").alias("first"), text.occurrences(F.col("text"), "er").cast("long").alias("n"))


@query("x9_split_lines", "SELECT package_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN right(text, 1) = chr(10) THEN 1 ELSE 0 END END AS BIGINT) AS lines FROM package")
def x9(spark, d):
    return b.packages(spark, d).select("package_id", F.size(text.split_lines(F.col("text"))).cast("long").alias("lines"))


@query("x11_space_attribute", "SELECT package_id, idx, regexp_matches(text, '^ | $') AS needs_space FROM paragraph")
def x11(spark, d):
    return b.paragraphs(spark, d).select(*PK, text.needs_space_attribute(F.col("text")).alias("needs_space"))


@query("x13_emu_pixels", "SELECT p_partkey AS image, CAST(floor(p_size * 100000 / 9525) AS BIGINT) AS pixels FROM part")
def x13(spark, d):
    return b.read(spark, d, "part").select(F.col("p_partkey").alias("image"), text.emu_to_pixels(F.col("p_size") * 100000).alias("pixels"))


@query("x16_resolved_targets", "SELECT package_id, ordinal, concat('word/', regexp_replace(target, '^/', '')) AS resolved FROM relationship")
def x16(spark, d):
    up = F.concat(F.lit("../"), F.regexp_replace("target", "^/", ""))
    return b.relationships(spark, d).select("package_id", "ordinal", text.resolve_target(F.lit("word/media"), up).alias("resolved"))


@query("x17_base64", "SELECT package_id, ordinal, base64(encode(interior)) AS encoded FROM opaque")
def x17(spark, d):
    return b.opaque_blocks(spark, d).select("package_id", "ordinal", F.translate(F.base64(F.encode("interior", "UTF-8")), "\r\n", "").alias("encoded"))