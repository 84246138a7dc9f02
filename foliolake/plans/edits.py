"""Edits, settlements and table operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.functions import keys
from foliolake.operators import edits as op
from foliolake.operators import inventory, tables
from foliolake.plans.registry import query
from foliolake.sources import bindings as b

PK = ["package_id", "idx"]


@query("d1_text_units", "SELECT package_id, u AS unit, count(*) AS n FROM (SELECT package_id, unnest(string_split(text, '')) AS u FROM package WHERE text <> '') GROUP BY ALL")
def d1(spark, d):
    units = b.packages(spark, d).filter("text <> ''").select("package_id", F.explode(F.split("text", "")).alias("unit"))
    return units.groupBy("package_id", "unit").agg(F.count("*").alias("n"))


def _common(a: str, c: str) -> str:
    return f"CASE WHEN {a} = {c} THEN length({a}) ELSE list_position(list_transform(range(1, greatest(length({a}), length({c})) + 1), lambda i: coalesce(nullif({a}[i], '') = nullif({c}[i], ''), false)), false) - 1 END"


_TRIM = f"""WITH v AS (SELECT package_id, idx, coalesce(string_agg(text, ' ' ORDER BY k) FILTER (in_original), '') AS a, coalesce(string_agg(text, ' ' ORDER BY k) FILTER (in_final), '') AS c FROM segment GROUP BY ALL),
h AS (SELECT *, {_common("a", "c")} AS head FROM v), r AS (SELECT *, reverse(substring(a, head + 1)) AS ra, reverse(substring(c, head + 1)) AS rc FROM h), t AS (SELECT *, {_common("ra", "rc")} AS tail FROM r)
SELECT package_id, idx, CAST(head AS BIGINT) AS start, substring(a, head + 1, length(a) - head - tail) AS old, substring(c, head + 1, length(c) - head - tail) AS new FROM t"""


@query("d4_trim_diff", _TRIM)
def d4(spark, d):
    views = inventory.views(b.segments(spark, d))
    return views.select(*PK, op.trim_diff(F.col("original"), F.col("final")).alias("x")).select(*PK, "x.start", "x.old", "x.new")


@query("d5_tracked_replacements", """SELECT package_id, idx, k, CAST(step AS BIGINT) AS step, op, left(t, 120) AS text, row_number() OVER (PARTITION BY package_id ORDER BY idx, k, step) - 1 AS w_id
FROM (SELECT package_id, idx, k, unnest([0, 1]) AS step, unnest(['delete', 'insert']) AS op, unnest([text, concat('<', text, '>')]) AS t FROM leaf WHERE k % 13 = 6)""")
def d5(spark, d):
    return op.track_replacements(b.leaves(spark, d), F.col("k") % 13 == 6, F.concat(F.lit("<"), "text", F.lit(">")))


@query("d6_island_edit", """SELECT package_id, idx, CASE WHEN n = 1 THEN replace(text, 'er', '<>') ELSE text END AS edited, CASE WHEN n = 0 THEN 'not-found' WHEN n > 1 THEN 'ambiguous' END AS code
FROM (SELECT *, (length(text) - length(replace(text, 'er', ''))) // 2 AS n FROM paragraph)""")
def d6(spark, d):
    return op.island_edit(b.paragraphs(spark, d), "er", "<>").select(*PK, "edited", "code")


@query("f11_ambiguity_guard", "SELECT package_id, idx, k, n = 1 AS editable FROM (SELECT *, (length(text) - length(replace(text, 'an', ''))) // 2 AS n FROM leaf) WHERE n > 0")
def f11(spark, d):
    found = op.island_edit(b.leaves(spark, d), "an", "").filter("code is null or code = 'ambiguous'")
    return found.select(*PK, "k", F.col("code").isNull().alias("editable"))


_EDITS = [("the", "THE"), ("er", "re"), ("THE", "The")]


@query("d7_batch_edit", "SELECT package_id, idx, replace(replace(replace(text, 'the', 'THE'), 'er', 're'), 'THE', 'The') AS edited FROM paragraph")
def d7(spark, d):
    return b.paragraphs(spark, d).select(*PK, op.batch_edit(F.col("text"), _EDITS).alias("edited"))


@query("d8_insert_delete_paragraphs", """SELECT package_id, row_number() OVER (PARTITION BY package_id ORDER BY idx, sub) - 1 AS new_idx, text, inherits FROM (SELECT package_id, idx, 0 AS sub, text, NULL AS inherits FROM paragraph WHERE idx % 7 <> 3
UNION ALL SELECT package_id, idx, 1, concat('after ', paragraph_id), paragraph_id FROM paragraph WHERE idx % 5 = 2)""")
def d8(spark, d):
    return op.insert_and_delete_paragraphs(b.paragraphs(spark, d), F.col("idx") % 5 == 2, F.concat(F.lit("after "), "paragraph_id"), F.col("idx") % 7 == 3)


@query("d9_settle_one", """WITH o AS (SELECT package_id, min(idx * 100000 + k) AS first_at FROM segment WHERE kind IS NOT NULL GROUP BY package_id)
SELECT s.package_id, idx, k, CASE WHEN (idx * 100000 + k) IS DISTINCT FROM first_at THEN kind END AS kind, text FROM segment s LEFT JOIN o ON s.package_id = o.package_id WHERE NOT coalesce(idx * 100000 + k = first_at AND kind IN ('delete', 'move_from'), false)""")
def d9(spark, d):
    rows = b.segments(spark, d).withColumn("at", F.col("idx").cast("long") * 100000 + F.col("k"))
    first = rows.filter("kind is not null").groupBy("package_id").agg(F.min("at").alias("first"))
    return op.settle(rows.join(first, "package_id", "left"), True, F.col("at") == F.col("first")).select(*PK, "k", "kind", "text")


@query("d10_accept_all", "SELECT package_id, idx, k, text, NULL AS kind FROM segment WHERE in_final".replace("NULL AS kind", "CAST(NULL AS VARCHAR) AS kind"))
def d10(spark, d):
    return op.settle(b.segments(spark, d), True).select(*PK, "k", "text", "kind")


@query("d10_reject_all", "SELECT package_id, idx, k, text, CAST(NULL AS VARCHAR) AS kind FROM segment WHERE in_original")
def d10_reject(spark, d):
    return op.settle(b.segments(spark, d), False).select(*PK, "k", "text", "kind")


@query("d11_reinserted", """WITH m AS (SELECT package_id, max(CAST(w_id AS BIGINT)) AS top FROM revision_row GROUP BY ALL)
SELECT package_id, idx, k, 'new-insert-after-deletion' AS operation, text, top + row_number() OVER (PARTITION BY package_id ORDER BY idx, k) AS w_id FROM revision_row JOIN m USING (package_id) WHERE kind IN ('delete', 'move_from')""")
def d11(spark, d):
    from pyspark.sql import Window

    rows = b.revisions(spark, d)
    top = rows.groupBy("package_id").agg(F.max(F.col("w_id").cast("long")).alias("top"))
    number = F.row_number().over(Window.partitionBy("package_id").orderBy("idx", "k"))
    again = rows.filter(F.col("kind").isin("delete", "move_from")).join(top, "package_id")
    return again.select(*PK, "k", F.lit("new-insert-after-deletion").alias("operation"), "text", (F.col("top") + number).alias("w_id"))


@query("d13_insert_row", """SELECT table_index, row_number() OVER (PARTITION BY table_index ORDER BY row_index, sub) - 1 AS new_row, cells FROM (SELECT table_index, row_index, 0 AS sub, cells FROM cell_row
UNION ALL SELECT table_index, row_index, 1, ['', '', '', ''] FROM cell_row WHERE row_index = 0)""")
def d13_insert_row(spark, d):
    return tables.insert_row(b.cell_rows(spark, d), 0)


@query("d13_delete_row", "SELECT table_index, row_number() OVER (PARTITION BY table_index ORDER BY row_index) - 1 AS new_row, cells FROM cell_row WHERE row_index <> 1")
def d13_delete_row(spark, d):
    return tables.delete_row(b.cell_rows(spark, d), 1)


@query("d13_insert_column", "SELECT table_index, row_index, [cells[1], cells[2], '', cells[3], cells[4]] AS cells FROM cell_row")
def d13_insert_column(spark, d):
    return tables.insert_column(b.cell_rows(spark, d), 1)


@query("d13_delete_column", "SELECT table_index, row_index, [cells[1], cells[2], cells[4]] AS cells FROM cell_row")
def d13_delete_column(spark, d):
    return tables.delete_column(b.cell_rows(spark, d), 2)


@query("d14_merge_cells", """SELECT table_index, row_index, CASE WHEN keep THEN [c[1], c[2], c[4]] ELSE c END AS cells, CAST(CASE WHEN keep THEN 2 ELSE 1 END AS BIGINT) AS grid_span, CASE WHEN NOT keep THEN 'merge-would-discard-content' END AS code
FROM (SELECT *, c[3] = '' AS keep FROM (SELECT table_index, row_index, [cells[1], cells[2], CASE WHEN cells[3] = '0' THEN '' ELSE cells[3] END, cells[4]] AS c FROM cell_row))""")
def d14_merge(spark, d):
    blank = F.transform("cells", lambda c, i: F.when((i == 2) & (c == "0"), "").otherwise(c))
    return tables.merge_cells(b.cell_rows(spark, d).withColumn("cells", blank), 1, 2)


@query("d14_split_cells", "SELECT table_index, row_index, [cells[1], '', '', cells[2], cells[3], cells[4]] AS cells FROM cell_row")
def d14_split(spark, d):
    return tables.split_cell(b.cell_rows(spark, d), 0, 3)


_NORMAL = "text"
for _s, _t, _c, _ in b.CATALOG:
    if _c == "mapped":
        _NORMAL = f"replace({_NORMAL}, '{_s}', '{_t}')"


@query("d15_normalized", f"SELECT package_id, sha256({_NORMAL}) AS text_sha256, {_NORMAL} <> text AS changed FROM package")
def d15(spark, d):
    recipes = [(s, t) for s, t, c, _ in b.CATALOG if c == "mapped"]
    rows = b.packages(spark, d).withColumn("normal", op.batch_edit(F.col("text"), recipes))
    return rows.select("package_id", keys.sha(F.col("normal")).alias("text_sha256"), (F.col("normal") != F.col("text")).alias("changed"))


@query("x20_recipe_replacement", "SELECT package_id, idx, translate(text, 'éèêçñ', 'eeecn') AS plain FROM paragraph")
def x20(spark, d):
    return b.paragraphs(spark, d).select(*PK, F.translate("text", "éèêçñ", "eeecn").alias("plain"))


@query("d16_draft_preview", """SELECT package_id, idx, left(text, 60) AS before, left(draft, 60) AS after FROM (SELECT *, CASE WHEN idx % 6 = 1 THEN replace(text, 'en', 'EN') ELSE text END AS draft FROM paragraph) WHERE draft <> text""")
def d16(spark, d):
    draft = F.when(F.col("idx") % 6 == 1, F.replace("text", F.lit("en"), F.lit("EN"))).otherwise(F.col("text"))
    rows = b.paragraphs(spark, d).withColumn("draft", draft).filter("draft <> text")
    return rows.select(*PK, F.left("text", F.lit(60)).alias("before"), F.left("draft", F.lit(60)).alias("after"))


@query("d16_committed_drafts", """SELECT package_id, idx, CASE WHEN drafted AND NOT stale THEN concat('* ', text) ELSE text END AS text, CASE WHEN drafted THEN CASE WHEN stale THEN 'stale-draft' ELSE 'committed' END END AS code
FROM (SELECT *, idx % 3 = 1 AS drafted, left(sha256(CASE WHEN package_id % 4 = 0 THEN concat(text, '~') ELSE text END), 12) <> left(sha256(text), 12) AS stale FROM paragraph)""")
def d16_commit(spark, d):
    """Drafts take effect unless the text that they were made of has changed since."""
    rows = b.paragraphs(spark, d)
    base = keys.fingerprint12(F.when(F.col("package_id") % 4 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text")))
    drafts = rows.filter("idx % 3 = 1").select(*PK, F.concat(F.lit("* "), "text").alias("draft"), base.alias("base_fingerprint"))
    return op.commit(rows, drafts)


@query("d16_reverted_drafts", "SELECT package_id, idx, text, idx % 3 = 1 AS reverted FROM paragraph")
def d16_revert(spark, d):
    rows = b.paragraphs(spark, d)
    drafted = rows.withColumn("text", F.when(F.col("idx") % 3 == 1, F.concat(F.lit("* "), "text")).otherwise(F.col("text")))
    """A draft taken back by its record, which holds only what changed."""
    return op.undo(drafted, op.record(rows, drafted)).select(*PK, "text", "reverted")


@query("d17_settlement", """SELECT r.package_id, count(*) AS revisions, bool_and(code IS NULL) AS settled, min(code) AS first_code, count(*) FILTER (operation = 'unwrap') AS unwrapped, count(*) FILTER (operation = 'remove') AS removed FROM (SELECT v.package_id,
CASE WHEN d.decision = 'defer' THEN 'deferred' WHEN k % 97 = 0 THEN 'fingerprint-mismatch' END AS code, CASE WHEN (d.decision = 'approved') = (kind IN ('insert', 'move_to')) THEN 'unwrap' ELSE 'remove' END AS operation
FROM revision_row v JOIN decision d USING (package_id)) r GROUP BY r.package_id""")
def d17(spark, d):
    rows = b.revisions(spark, d).join(b.decisions(spark, d), "package_id")
    code = F.when(F.col("decision") == "defer", "deferred").when(F.col("k") % 97 == 0, "fingerprint-mismatch")
    unwrap = (F.col("decision") == "approved") == F.col("kind").isin("insert", "move_to")
    marked = rows.withColumns({"code": code, "unwrap": unwrap})
    return marked.groupBy("package_id").agg(F.count("*").alias("revisions"), F.bool_and(F.col("code").isNull()).alias("settled"), F.min("code").alias("first_code"), F.count_if("unwrap").alias("unwrapped"), F.count_if(~F.col("unwrap")).alias("removed"))


@query("a7_cell_groups", """SELECT table_index, col_index, count(*) AS cells, min(row_index) AS first_row, max(row_index) AS last_row, string_agg(text, ',' ORDER BY row_index) AS texts FROM cell GROUP BY ALL""")
def a7(spark, d):
    rows = F.sort_array(F.collect_list(F.struct("row_index", "text")))
    return b.cells(spark, d).groupBy("table_index", "col_index").agg(F.count("*").alias("cells"), F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row"), F.array_join(F.transform(rows, lambda r: r["text"]), ",").alias("texts"))


@query("a8_table_shape", "SELECT table_index, count(DISTINCT row_index) AS rows, count(*) AS cells FROM cell GROUP BY ALL")
def a8(spark, d):
    return b.cells(spark, d).groupBy("table_index").agg(F.count_distinct("row_index").alias("rows"), F.count("*").alias("cells"))
