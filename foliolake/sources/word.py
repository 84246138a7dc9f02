"""The document model's relations from real Word packages.

Everything is made of the items of ``docx.prose_items``. A paragraph's number
``idx`` counts the package's paragraphs, part after part: the document's first,
then headers, footers and notes, so (package_id, idx) names a paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.functions.keys import revision_key, style_id
from foliolake.operators.ranges import containing
from foliolake.sources import docx

PK = ["package_id", "idx"]
#: Bits of idx that count a part's paragraphs; those above them count the parts.
PARAGRAPH_BITS = 40
_GONE = {True: ("delete", "move_from"), False: ("insert", "move_to")}


def items(members: DataFrame) -> DataFrame:
    """Items of all prose parts with idx; parts are numbered in the order of extraction when a package is opened."""
    found = docx.prose_items(members)
    return found.withColumn("idx", F.shiftleft("part_no", PARAGRAPH_BITS) + F.col("paragraph_order"))


def hidden(accept: bool) -> Column:
    """Whether an item lies in a revision that this decision removes."""
    return F.exists("revisions", lambda r: r["kind"].isin(*_GONE[accept]))


def segments(items: DataFrame) -> DataFrame:
    """Text runs with offsets, style, innermost revision and visibility; k counts a paragraph's runs."""
    order = Window.partitionBy(*PK).orderBy("position")
    texts = items.filter("item = 'text'")
    size = F.length("text").cast("long")
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    last = F.try_element_at("revisions", F.lit(-1))
    return texts.select(
        "package_id", "part", "idx", "paragraph_id", (F.row_number().over(order) - 1).alias("k"), "position", "text", before.alias("start"), (before + size).alias("end"),
        style_id(F.col("style")).alias("style_id"), last["kind"].alias("kind"), last["w_id"].alias("w_id"), last["author"].alias("author"), last["date"].alias("date"),
        F.when(last.isNotNull(), revision_key(F.concat(F.lit("word/"), "part", F.lit(".xml")), last["kind"], last["w_id"], F.col("text"))).alias("revision"),
        (~hidden(False)).alias("in_original"), (~hidden(True)).alias("in_final"),
    )


def paragraphs(items: DataFrame) -> DataFrame:
    """Paragraphs with an item: canonical text, runs, opaque blocks, and whether they can be edited."""
    rows = F.sort_array(F.collect_list(F.when(F.col("item") == "text", F.struct("position", "text"))))
    of = lambda item: F.count_if(F.col("item") == item)
    found = items.filter("paragraph_id is not null").groupBy("package_id", "part", "idx", "paragraph_id")
    return found.agg(F.array_join(F.transform(rows, lambda r: r["text"]), "").alias("text"), of("text").alias("leaf_count"), of("opaque").alias("opaque_count"), (of("opaque") == 0).alias("editable"))


def revisions(items: DataFrame) -> DataFrame:
    """Tracked changes: one row for each revision element, with its text, paragraph and whether and why it is locked.

    Paragraph marks can be seen but not settled one by one; what stands in another
    part, or in a paragraph with an opaque block, is locked.
    """
    opaque = items.filter("item = 'opaque'").select(*PK, F.lit(True).alias("opaque")).distinct()
    each = items.filter(F.size("revisions") > 0).select("package_id", "part", "idx", "paragraph_id", "position", "item", "text", F.explode("revisions").alias("r"))
    rows = F.sort_array(F.collect_list(F.when(F.col("item") == "text", F.struct("position", "text"))))
    found = each.groupBy("package_id", "part", "r.kind", "r.w_id", "r.author", "r.date").agg(
        F.min_by("paragraph_id", "position").alias("paragraph_id"), F.min_by("idx", "position").alias("idx"), F.bool_and(F.col("item") == "mark").alias("mark"),
        F.array_join(F.transform(rows, lambda r: r["text"]), "").alias("text"),
    )
    reason = F.when(F.col("mark"), "paragraph-mark-revision").when(F.col("part") != "document", "nested-container-or-non-editable-part").when(F.col("opaque"), "paragraph-contains-unsupported-node")
    return found.join(opaque, PK, "left").select(
        "package_id", "part", "idx", "paragraph_id", "kind", "w_id", "author", "date", "text", revision_key(F.concat(F.lit("word/"), "part", F.lit(".xml")), F.col("kind"), F.col("w_id"), F.col("text")).alias("revision"),
        reason.alias("reason"), reason.isNull().alias("editable"), F.when(F.col("mark"), "paragraph-mark").alias("scope"),
    )


def comment_anchors(items: DataFrame) -> DataFrame:
    """id, part, paragraph_id, kind, ordinal of every comment anchor."""
    return items.filter(F.col("item").startswith("comment-")).select("package_id", F.col("ref").alias("id"), F.concat(F.lit("word/"), "part", F.lit(".xml")).alias("part"), "paragraph_id", F.col("item").alias("kind"), F.col("position").alias("ordinal"))


def open_comments(items: DataFrame) -> DataFrame:
    """For each text run inside comment ranges: package_id, part, position, and the comments, by where they begin."""
    ends = items.filter("item in ('comment-start', 'comment-end')")
    ranges = ends.groupBy("package_id", "part", "ref").agg(F.min(F.when(F.col("item") == "comment-start", F.col("position"))).alias("start"), F.max(F.when(F.col("item") == "comment-end", F.col("position"))).alias("end"))
    inside = containing(items.filter("item = 'text'").select("package_id", "part", "position"), ranges.filter("start is not null and end is not null"), ["package_id", "part"], bucket=64)
    rows = F.sort_array(F.collect_list(F.struct("start", "ref")))
    return inside.groupBy("package_id", "part", "position").agg(F.transform(rows, lambda r: r["ref"]).alias("comment_ids"))


def cells(paragraphs: DataFrame) -> DataFrame:
    """Cells of the body's tables: package_id, table_index, row_index, col_index, text of their paragraphs, joined by line ends."""
    place = r"^T([0-9]+)\.R([0-9]+)\.C([0-9]+)\.P[0-9]+$"
    at = lambda k: F.regexp_extract("paragraph_id", place, k).cast("int")
    found = paragraphs.filter(F.col("paragraph_id").rlike(place)).select("package_id", at(1).alias("table_index"), at(2).alias("row_index"), at(3).alias("col_index"), "idx", "text")
    rows = F.sort_array(F.collect_list(F.struct("idx", "text")))
    return found.groupBy("package_id", "table_index", "row_index", "col_index").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def settle(items: DataFrame, accept: bool) -> DataFrame:
    """All revisions settled: removed text goes, what is left becomes plain, paragraph marks go either way.

    Anchors inside removed text stay where it was, so their pairs stay whole.
    """
    anchor = F.col("item").contains("-")
    kept = items.filter((F.col("item") != "mark") & (anchor | ~hidden(accept)))
    return kept.withColumn("revisions", F.array().cast(f"array<{docx.REVISION}>"))


def delete_comments(items: DataFrame, entries: DataFrame, extended: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, comment entries and extended entries without the comments of ``ids`` (package_id, id), or without any."""
    every = ids is None
    if every:
        ids = entries.select("package_id", "id").unionByName(comment_anchors(items).select("package_id", "id"))
    gone = ids.select("package_id", "id").distinct()
    kept = entries.join(gone, ["package_id", "id"], "left_anti")
    extra = entries.join(gone, ["package_id", "id"], "left_semi").select("package_id", "para_id")
    anchor = F.col("item").startswith("comment-")
    without = items.filter(anchor).join(gone.withColumnRenamed("id", "ref"), ["package_id", "ref"], "left_anti").unionByName(items.filter(~anchor))
    return without, kept, extended.filter(F.lit(False)) if every else extended.join(extra, ["package_id", "para_id"], "left_anti")
