"""Acceptance of edited packages: what is observed of the source and of the output, and the assertions over both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.sources import docx, word
from foliolake.sources.shared import written

_BOUNDARIES = ("comment-start", "comment-end", "bookmark-start", "bookmark-end")


def _different(found: Column, wanted: Column) -> Column:
    """How many members of two sets are in one of them only."""
    return F.size(F.array_except(found, wanted)) + F.size(F.array_except(wanted, found))


def _places(pattern: str) -> Column:
    """The number of tables' rows or cells that paragraphs stand in."""
    place = F.regexp_extract("paragraph_id", pattern, 1)
    return F.size(F.collect_set(F.when(place != "", place)))


def _item_counts(items: DataFrame) -> DataFrame:
    of = lambda name: F.count_if(F.col("item") == name)
    seen = F.when((F.col("item") == "text") & ~word.hidden(True), F.struct("idx", "position", "text"))
    last = F.try_element_at("revisions", F.lit(-1))
    return items.groupBy("package_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(seen)), lambda r: r["text"]), "").alias("visible"),
        F.array(*[of(name) for name in _BOUNDARIES]).alias("boundaries"),
        F.sort_array(F.collect_set(F.when(F.col("item") == "comment-start", F.col("ref")))).alias("anchored"),
        of("opaque").alias("opaques"),
        of("mark").alias("marks"),
        F.size(F.collect_set(F.when((F.col("item") != "mark") & last.isNotNull(), F.struct("part", last["kind"], last["w_id"])))).alias("revisions"),
        F.size(F.collect_set(F.when(F.col("part") == "document", F.col("paragraph_id")))).alias("paragraphs"),
        _places(r"^(T[0-9]+\.R[0-9]+)\.").alias("rows"),
        _places(r"^(T[0-9]+\.R[0-9]+\.C[0-9]+)\.").alias("cells"),
    )


def read(packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and items of packages (package_id, content) that open, each written once, since every assertion looks at them."""
    members = written(docx.members(packages).filter("error is null"), "acceptance-members")
    return members, written(word.items(members), "acceptance-items")


def observations(members: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each package; its collections are no larger than the package."""
    spans = F.size(F.regexp_extract_all(F.col("content").cast("string"), F.lit('<w:gridSpan w:val="([2-9]|[1-9][0-9]+)"'), F.lit(1)))
    parts = members.groupBy("package_id").agg(
        F.collect_set(F.struct("part_path", "sha256")).alias("parts"),
        F.coalesce(F.sum(F.when(F.col("part_path") == "word/document.xml", spans)), F.lit(0)).alias("spans"),
    )
    entries = docx.comment_entries(members).groupBy("package_id").agg(F.collect_set(F.struct("id", "author", "date", "text")).alias("entries"))
    found = parts.join(_item_counts(items), "package_id", "left").join(entries, "package_id", "left")
    none = F.array().cast(entries.schema["entries"].dataType)
    return found.withColumn("entries", F.coalesce("entries", none))


def duplicated_cells(before: DataFrame, after: DataFrame) -> DataFrame:
    """package_id, duplicated: cell texts of the source's items that the output has more often."""
    cells = lambda items, n: word.cells(word.paragraphs(items)).filter("text <> ''").groupBy("package_id", "text").agg(F.count("*").alias(n))
    both = cells(before, "n").join(cells(after, "m"), ["package_id", "text"])
    return both.groupBy("package_id").agg(F.count_if(F.col("m") > F.col("n")).alias("duplicated"))


def assertions(before: DataFrame, after: DataFrame, edited: tuple[str, ...], present: str, absent: str) -> DataFrame:
    """package_id, oracle, observed, passed for each source package (package_id, content) and its output.

    ``edited`` are the parts that may change; the comment ``present`` must have an
    entry and an anchor, the comment ``absent`` neither. An output that doesn't
    open, or isn't there, passes nothing and has null observed.
    """
    source, output = read(before), read(after)
    old = observations(*source)
    old = old.select("package_id", *[F.col(c).alias(f"{c}_0") for c in old.columns if c != "package_id"])
    rows = old.join(observations(*output), "package_id", "left").join(duplicated_cells(source[1], output[1]), "package_id", "left")
    kept = lambda c: F.filter(c, lambda p: ~p["part_path"].isin(*edited))
    there = F.col("parts").isNotNull()
    same = lambda c: F.col(c).eqNullSafe(F.col(f"{c}_0"))
    has_entry = lambda i: F.exists("entries", lambda e: e["id"] == i)
    has_anchor = lambda i: F.coalesce(F.array_contains("anchored", i), F.lit(False))
    signs = lambda i: has_entry(i).cast("long") + has_anchor(i).cast("long")
    parts, other = _different(F.col("parts"), F.col("parts_0")), _different(kept("parts"), kept("parts_0"))
    comments = _different(F.col("entries"), F.col("entries_0"))
    repeated = F.coalesce("duplicated", F.lit(0))
    checks = {
        "byte_identical": (parts, parts == 0),
        "parts_unchanged": (other, other == 0),
        "text_signature_same": (F.length("visible"), same("visible")),
        "anchors_intact": (F.aggregate("boundaries", F.lit(0).cast("long"), lambda a, x: a + x), same("boundaries")),
        "comments_preserved": (comments, comments == 0),
        "opaque_interior_unchanged": (F.col("opaques"), same("opaques")),
        "paragraph_count": (F.col("paragraphs"), same("paragraphs")),
        "paragraph_marks": (F.col("marks"), same("marks")),
        "row_col_counts": (F.col("cells"), same("rows") & same("cells")),
        "no_text_duplication": (repeated, repeated == 0),
        "grid_span_clean": (F.col("spans"), F.col("spans") == 0),
        "revision_count": (F.col("revisions"), same("revisions")),
        "residual_revisions": (F.col("revisions"), F.col("revisions") == 0),
        "comment_present": (signs(present), signs(present) == 2),
        "comment_absent": (signs(absent), signs(absent) == 0),
    }
    each = [F.struct(F.lit(name).alias("oracle"), F.when(there, seen.cast("long")).alias("observed"), F.coalesce(there & holds, F.lit(False)).alias("passed")) for name, (seen, holds) in checks.items()]
    return rows.select("package_id", F.explode(F.array(*each)).alias("a")).select("package_id", "a.*")
