"""Edits of packages as splices: byte ranges of parts with what comes in their place.

A splice is (package_id, part_path, start, end, pieces): the range goes, and the
pieces come, each a literal or a range of the same part that is copied. No pieces
is a deletion, an empty range an insertion. Splices are made by joins from the
spans of elements (``docx.spans``); ``disjoint`` brings them into a form in which
order doesn't matter, or says where they conflict; ``applied`` folds them into
the packages, one pass over each part, and leaves all other members as they are
stored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.functions.batches import map_records
from foliolake.operators.ranges import containing
from foliolake.sources import docx, zipraw
from foliolake.sources.shared import written

PART = ["package_id", "part_path"]
PIECES = "array<struct<literal:string,start:bigint,end:bigint>>"
EDITED = "package_id long, part_path string, sha256 string, stored boolean"

# Elements of tracked changes by what accepting them does, and elements that mark places.
INSERTED, DELETED = ("ins", "moveTo"), ("del", "moveFrom")
ANCHORS = ("commentRangeStart", "commentRangeEnd", "commentReference", "bookmarkStart", "bookmarkEnd")
WANTED = (*INSERTED, *DELETED, *ANCHORS, "delText", "t", "r", "rPr", "p", "pPr", "tbl", "tr", "trPr", "tc", "tcPr", "gridSpan", "comment", "commentEx")

#: What tracked replacements look at: revisions, what has an id, and what stands in runs.
TRACKED = (*INSERTED, *DELETED, *ANCHORS, "delText", "t", "rPr", "p", "comment", "commentEx")


def literal(text: Column) -> Column:
    """A piece that is written as it is."""
    return F.struct(text.cast("string").alias("literal"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))


def copied(start: Column, end: Column) -> Column:
    """A piece that is a range of the part before all edits."""
    return F.struct(F.lit(None).cast("string").alias("literal"), start.cast("long").alias("start"), end.cast("long").alias("end"))


def splices(rows: DataFrame, start: Column | str, end: Column | str, *pieces: Column) -> DataFrame:
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select(*PART, column(start).alias("start"), column(end).alias("end"), (F.array(*pieces) if pieces else F.array().cast(PIECES)).alias("pieces"))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def disjoint(given: DataFrame, kept: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Splices of which no two touch the same byte, and conflicts (package_id, part_path, start, end, reason).

    Deletions are united, less the ranges of ``kept`` (package_id, part_path,
    start, end). Splices that are the same are one. What overlaps a replacement,
    or is put inside a deletion, conflicts, and nothing of its package is edited.
    Insertions at one place come in the order of their pieces.
    """
    order = Window.partitionBy(*PART).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cuts = given.filter((F.size("pieces") == 0) & (F.col("end") > F.col("start"))).select(*PART, "start", "end").distinct()
    number = F.sum(F.when(F.col("start") <= before, 0).otherwise(1)).over(order)
    united = cuts.withColumn("island", number).groupBy(*PART, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    if kept is not None:
        inside = containing(kept.select(*PART, F.col("start").alias("from"), F.col("end").alias("to")).distinct(), united, PART, "from")
        holes = inside.groupBy(*PART, "island").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("holes"))
        found = united.join(holes, [*PART, "island"], "left").withColumn("holes", F.coalesce("holes", F.array().cast("array<struct<from:bigint,to:bigint>>")))
        starts, ends = F.concat(F.array("start"), F.col("holes.to")), F.concat(F.col("holes.from"), F.array("end"))
        united = found.select(*PART, F.explode(F.arrays_zip(starts.alias("start"), ends.alias("end"))).alias("r")).select(*PART, "r.start", "r.end").filter("start < end")
    # one exchange: what follows looks at parts, and then at the packages that hold them
    rows = splices(united, "start", "end").unionByName(given.filter(F.size("pieces") > 0)).repartition("package_id")
    order = Window.partitionBy(*PART).orderBy("start", "end", F.to_json("pieces"))
    whole = F.struct("start", "end", "pieces")
    rows = rows.withColumn("again", F.lag(whole).over(order).eqNullSafe(whole)).filter("not again").drop("again")
    rows = rows.withColumn("before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    clash = rows.filter(F.col("start") < F.col("before")).select(*PART, "start", "end", F.when(F.size("pieces") == 0, "removes-what-is-replaced").otherwise("replaces-what-is-edited").alias("reason"))
    stopped = F.coalesce(F.bool_or(F.col("start") < F.col("before")).over(Window.partitionBy("package_id")), F.lit(False))
    return rows.withColumn("stopped", stopped).filter("not stopped").drop("before", "stopped"), clash


def applied(packages: DataFrame, edits: DataFrame) -> DataFrame:
    """Packages (package_id, content) after disjoint splices; a package without any keeps its bytes, as does one that can't be read."""

    def fold(record):
        yield record.package_id, _folded(record.content, record.edits)

    return map_records(_with_edits(packages, edits), fold, docx.PACKAGES)


def edited_members(packages: DataFrame, edits: DataFrame) -> DataFrame:
    """The members of packages as ``applied`` makes them, read from the new archive: digests, and whether they stand there byte for byte as before.

    Each archive is read where it is made, so none is written or dealt again.
    """

    def read(record):
        after = _folded(record.content, record.edits)
        try:
            before, now = zipraw.stored_bytes(record.content or b""), zipraw.stored_bytes(after or b"")
        except ValueError:
            return
        for member in docx.members_of(record.package_id, after):
            name = member[1]
            if name in before and name in now:
                yield record.package_id, name, member[4], now[name] == before[name]

    return map_records(_with_edits(packages, edits), read, EDITED)


def _with_edits(packages: DataFrame, edits: DataFrame) -> DataFrame:
    """Packages with their splices in order, or null."""
    each = F.struct("part_path", "start", "end", F.to_json("pieces").alias("order"), "pieces")
    listed = edits.groupBy("package_id").agg(F.sort_array(F.collect_list(each)).alias("edits"))
    return packages.select("package_id", "content").join(listed, "package_id", "left")


def _folded(content: bytes | None, edits: list | None) -> bytes | None:
    if content is None or edits is None:
        return content
    read = zipraw.of_bytes(content)
    try:
        entries = {entry.name: entry for entry in zipraw.directory(read, len(content)).entries}
        by_part: dict[str, list] = {}
        for edit in edits:
            by_part.setdefault(edit["part_path"], []).append(edit)
        return zipraw.rewritten(content, {part: spliced(zipraw.member(read, entries[part]), found) for part, found in by_part.items() if part in entries})
    except ValueError:
        return content


def spliced(raw: bytes, edits: list) -> bytes:
    """A part's bytes after disjoint splices in order."""
    out, at = [], 0
    for edit in edits:
        out.append(raw[at : edit["start"]])
        out += [raw[int(p["start"]) : int(p["end"])] if p["literal"] is None else p["literal"].encode() for p in edit["pieces"]]
        at = edit["end"]
    return b"".join([*out, raw[at:]])


# what edits mean in bytes; spans are rows of docx.spans


def _named(spans: DataFrame, *names: str) -> DataFrame:
    return spans.filter(F.col("name").isin(*names))


def _child(spans: DataFrame, name: str, alias: str, *columns: str) -> DataFrame:
    """Elements of a name by their parents: package_id, part_path, parent, and columns with the alias before them."""
    return _named(spans, name).select(*PART, F.col("parent_idx").alias("parent"), *[F.col(c).alias(f"{alias}_{c}") for c in columns])


#: Elements with an end tag.
_WHOLE = "inner < end"


def settle(spans: DataFrame, accept: bool) -> tuple[DataFrame, DataFrame]:
    """All tracked changes of all parts accepted or rejected, and what stays of what they remove: anchors, and the runs of comment references."""
    gone, left = (DELETED, INSERTED) if accept else (INSERTED, DELETED)
    revisions = _named(spans, *gone, *left)
    tags = revisions.filter(F.col("name").isin(*left) & F.expr(_WHOLE))
    parts = [splices(revisions.filter(F.col("name").isin(*gone) | ~F.expr(_WHOLE)), "start", "end"), splices(tags, "start", "inner"), splices(tags, "inner_end", "end")]
    if not accept:  # what was deleted is text again
        inside = containing(_named(spans, "delText").select(*PART, "idx", F.col("start").alias("at")), revisions.filter(F.col("name").isin(*gone) & F.expr(_WHOLE)).select(*PART, "start", "end"), PART, "at")
        texts = _named(spans, "delText").join(inside.select(*PART, "idx").distinct(), [*PART, "idx"], "left_anti")
        name = lambda head: F.concat(F.lit(head), "prefix", F.lit("t"))
        opened = F.length("prefix") + len("<delText")
        parts += [splices(texts, F.col("start"), F.col("start") + opened, literal(name("<"))), splices(texts.filter(_WHOLE), F.col("inner_end"), F.col("end"), literal(F.concat(name("</"), F.lit(">"))))]
    anchors = _named(spans, *ANCHORS)
    runs = _named(spans, "r").select(*PART, F.col("idx").alias("parent_idx"), F.col("start").alias("r_start"), F.col("inner").alias("r_inner"), F.col("inner_end").alias("r_inner_end"), F.col("end").alias("r_end"))
    shells = anchors.filter("name = 'commentReference'").join(runs, [*PART, "parent_idx"])
    range_of = lambda rows, a, b: rows.select(*PART, F.col(a).alias("start"), F.col(b).alias("end"))
    kept = together(range_of(anchors, "start", "end"), range_of(shells, "r_start", "r_inner"), range_of(shells, "r_inner_end", "r_end"))
    return together(*parts), kept


def delete_comments(spans: DataFrame, ids: DataFrame) -> DataFrame:
    """The comments of ``ids`` (package_id, id) with their anchors, reference runs and extended entries."""
    gone = ids.select("package_id", F.col("id").alias("ref")).distinct()
    anchors = _named(spans, "commentRangeStart", "commentRangeEnd", "commentReference").join(gone, ["package_id", "ref"], "left_semi")
    # a reference goes with its run, unless there is more in it than properties
    inside = spans.filter(~F.col("name").isin("rPr", "commentReference")).select(*PART, F.col("parent_idx").alias("idx")).distinct()
    references = anchors.filter("name = 'commentReference'").select(*PART, F.col("parent_idx").alias("idx"))
    runs = _named(spans, "r").join(references.distinct(), [*PART, "idx"], "left_semi").join(inside, [*PART, "idx"], "left_anti")
    entries = _named(spans, "comment").join(gone, ["package_id", "ref"], "left_semi")
    order = Window.partitionBy("package_id", "parent_idx").orderBy(F.desc("idx"))
    paragraphs = _named(spans, "p").filter("part_path = 'word/comments.xml' and ref is not null").withColumn("r", F.row_number().over(order)).filter("r = 1")
    known = paragraphs.select(*PART, F.col("parent_idx").alias("idx"), F.col("ref").alias("para")).join(entries.select(*PART, "idx"), [*PART, "idx"], "left_semi")
    extended = _named(spans, "commentEx").join(known.select("package_id", F.col("para").alias("ref")).distinct(), ["package_id", "ref"], "left_semi")
    return together(*[splices(rows, "start", "end") for rows in (anchors, runs, entries, extended)])


def table_rows(spans: DataFrame) -> DataFrame:
    """Rows of the body's tables: package_id, part_path, idx, table_index, row_index, and the span's places."""
    body = spans.filter("name = 'tbl' and depth = 2 and part_path = 'word/document.xml'")
    tables = body.select(*PART, F.col("idx").alias("parent_idx"), (F.row_number().over(Window.partitionBy(*PART).orderBy("idx")) - 1).alias("table_index"))
    rows = _named(spans, "tr").join(tables, [*PART, "parent_idx"])
    return rows.withColumn("row_index", F.row_number().over(Window.partitionBy(*PART, "parent_idx").orderBy("idx")) - 1)


def table_cells(spans: DataFrame) -> DataFrame:
    """Cells of those rows, with table_index, row_index, col_index and whether they hold any text."""
    rows = table_rows(spans).select(*PART, F.col("idx").alias("parent_idx"), "table_index", "row_index")
    cells = _named(spans, "tc").join(rows, [*PART, "parent_idx"])
    cells = cells.withColumn("col_index", F.row_number().over(Window.partitionBy(*PART, "parent_idx").orderBy("idx")) - 1)
    texts = containing(_named(spans, "t").filter("text <> ''").select(*PART, F.col("start").alias("at")), cells.select(*PART, "idx", "start", "end"), PART, "at").select(*PART, "idx").distinct()
    return cells.join(texts.withColumn("filled", F.lit(True)), [*PART, "idx"], "left").fillna(False, ["filled"])


def insert_rows(spans: DataFrame, targets: DataFrame) -> DataFrame:
    """A row like each of ``targets`` (package_id, table_index, row_index), with empty cells, after it.

    The new row's tags and the properties of the row, its cells and their first paragraphs are copied.
    """
    rows = table_rows(spans).join(targets, ["package_id", "table_index", "row_index"], "left_semi").select(*PART, F.col("idx").alias("row"), "start", "inner", "inner_end", "end")
    ends = lambda found: together(found.select(*PART, "row", F.col("start").alias("a"), F.col("inner").alias("b")), found.filter(_WHOLE).select(*PART, "row", F.col("inner_end").alias("a"), F.col("end").alias("b")))
    below = lambda name, above: _named(spans, name).join(above.select(*PART, "row", F.col("idx").alias("parent_idx")), [*PART, "parent_idx"])
    all_of = lambda found: found.select(*PART, "row", F.col("start").alias("a"), F.col("end").alias("b"))
    cells = below("tc", rows.withColumn("idx", F.col("row")))
    first = Window.partitionBy(*PART, "parent_idx").orderBy("idx")
    paragraphs = below("p", cells).withColumn("n", F.row_number().over(first)).filter("n = 1")
    pieces = together(ends(rows), all_of(below("trPr", rows.withColumn("idx", F.col("row")))), ends(cells), all_of(below("tcPr", cells)), ends(paragraphs), all_of(below("pPr", paragraphs)))
    made = pieces.groupBy(*PART, "row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("ranges"))
    found = rows.join(made, [*PART, "row"])
    return found.select(*PART, F.col("end").alias("start"), "end", F.transform("ranges", lambda r: copied(r["a"], r["b"])).alias("pieces"))


def merge_cells(spans: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells joined for ``targets`` (package_id, table_index, row_index, first, count, discard), and those refused with a code.

    The first cell spans the columns of all; the others go, unless a text would be lost and ``discard`` is false.
    """
    key = ["package_id", "table_index", "row_index"]
    wide = _child(spans, "gridSpan", "grid", "start", "end", "ref").withColumnRenamed("parent", "properties")
    properties = _child(spans, "tcPr", "pr", "idx", "start", "inner", "inner_end", "end").withColumnsRenamed({"pr_idx": "properties", "parent": "idx"})
    cells = table_cells(spans).join(targets, key).filter("col_index >= first and col_index < first + count")
    cells = cells.join(properties, [*PART, "idx"], "left")
    cells = cells.join(wide, [*PART, "properties"], "left").withColumn("span", F.coalesce(F.expr("try_cast(grid_ref as int)"), F.lit(1)))
    cells = written(cells, "cells")
    head, later = F.col("col_index") == F.col("first"), F.col("col_index") > F.col("first")
    sums = cells.groupBy(*key, "first", "count", "discard").agg(F.sum("span").alias("columns"), F.count("*").alias("found"), F.coalesce(F.bool_or(later & F.col("filled")), F.lit(False)).alias("loses"))
    code = F.when(F.coalesce("found", F.lit(0)) < F.col("count"), "span-out-of-range").when(F.col("loses") & ~F.col("discard"), "merge-would-discard-content")
    judged = written(targets.join(sums.drop("first", "count", "discard"), key, "left").withColumn("code", code), "judged")
    merged = written(cells.join(judged.filter("code is null").select(*key, "columns"), key), "merged")
    grid = F.concat(F.lit("<"), "prefix", F.lit("gridSpan "), "prefix", F.lit('val="'), F.col("columns").cast("string"), F.lit('"/>'))
    wrapped = F.concat(F.lit("<"), "prefix", F.lit("tcPr>"), grid, F.lit("</"), "prefix", F.lit("tcPr>"))
    first = merged.filter(head)
    return together(
        splices(merged.filter(later), "start", "end"),
        splices(first.filter("grid_start is not null"), "grid_start", "grid_end", literal(grid)),
        splices(first.filter("grid_start is null and pr_inner < pr_end"), "pr_inner_end", "pr_inner_end", literal(grid)),
        splices(first.filter("grid_start is null and pr_inner = pr_end"), "pr_start", "pr_end", literal(wrapped)),
        splices(first.filter("properties is null"), "inner", "inner", literal(wrapped)),
    ), judged.filter("code is not null").select(*key, "code")


def track_replacements(spans: DataFrame, old: str, new: str, author: str, date: str) -> tuple[DataFrame, DataFrame]:
    """``old`` replaced by ``new`` as a tracked change, once in each text where it stands once, and refusals with a code.

    The run is cut in up to four: what stands before, the deletion, the insertion,
    what stands after, each with the run's properties. Inside a pending insertion
    the text is changed without a record; inside a deletion it is refused, as it
    is where a run holds more than one text or where ``old`` stands twice. New
    ids are the least numbers above all that the package uses.
    """
    revision = F.col("name").isin(*INSERTED, *DELETED) & F.expr(_WHOLE)
    # one exchange of what is in runs, what is around them and what has an id, with the texts that are edited; the rest are windows over a package
    times = F.floor((F.length("text") - F.length(F.replace("text", F.lit(old), F.lit("")))) / len(old))
    rows = spans.filter((F.col("parent_name") == "r") | F.col("ref").isNotNull() | revision).withColumn("times", times)
    rows = rows.withColumn("text", F.when(F.col("times") == 1, F.col("text"))).repartition("package_id")
    so_far = Window.partitionBy(*PART).orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = lambda names: F.coalesce(F.max(F.when(F.col("name").isin(*names) & revision, F.col("end"))).over(so_far) > F.col("start"), F.lit(False))
    siblings = Window.partitionBy(*PART, "parent_idx")
    used = F.max(F.expr("try_cast(ref as bigint)")).over(Window.partitionBy("package_id"))
    rows = rows.withColumns({"deleted": inside(DELETED), "inserted": inside(INSERTED), "most": F.coalesce(used, F.lit(-1))}).filter("parent_name = 'r'")
    properties = F.collect_list(F.when(F.col("name") == "rPr", F.struct("start", "end"))).over(siblings)
    rows = rows.withColumns({"children": F.count_if(F.col("name") != "rPr").over(siblings), "properties": F.sort_array(properties)})
    code = F.when(F.col("deleted"), "in-deletion").when(F.col("times") > 1, "ambiguous").when(F.col("children") > 1, "complex-run")
    texts = rows.filter("name = 't' and part_path = 'word/document.xml' and times > 0").withColumn("code", code)
    place = F.instr("text", old) - 1
    good = texts.filter("code is null").withColumns({"head": F.substring("text", F.lit(1), place), "tail": F.substring("text", place + len(old) + 1, F.length("text"))})
    direct = F.array(literal(_text("t", F.concat("head", F.lit(new), "tail"))))
    number = F.count_if(~F.col("inserted")).over(Window.partitionBy("package_id").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    good = good.withColumn("first", F.col("most") + 2 * number - 1)
    tag = lambda name, n: F.concat(F.lit("<"), "prefix", F.lit(f"{name} "), "prefix", F.lit('id="'), n.cast("string"), F.lit('" '), "prefix", F.lit(f'author="{author}" '), "prefix", F.lit(f'date="{date}">'))
    close = lambda name: F.concat(F.lit("</"), "prefix", F.lit(f"{name}>"))
    keep = F.transform("properties", lambda p: copied(p["start"], p["end"]))
    run = lambda name, text: F.concat(F.array(literal(F.concat(F.lit("<"), "prefix", F.lit("r>")))), keep, F.array(literal(F.concat(_text(name, text), close("r")))))
    some = lambda text: F.when(text != "", run("t", text)).otherwise(F.array().cast(PIECES))
    wrapped = lambda name, n, inner: F.concat(F.array(literal(tag(name, n))), inner, F.array(literal(close(name))))
    pieces = F.concat(some(F.col("head")), wrapped("del", F.col("first"), run("delText", F.lit(old))), wrapped("ins", F.col("first") + 1, run("t", F.lit(new))) if new else F.array().cast(PIECES), some(F.col("tail")))
    either = lambda within, record: F.when(F.col("inserted"), within).otherwise(record)
    edits = good.select(*PART, either(F.col("start"), F.col("parent_start")).alias("start"), either(F.col("end"), F.col("parent_end")).alias("end"), either(direct, pieces).alias("pieces"))
    return edits, texts.filter("code is not null").select(*PART, "idx", "code")


def _text(name: str, text: Column) -> Column:
    """A text element that keeps its spaces."""
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<"), "prefix", F.lit(f'{name} xml:space="preserve">'), escaped, F.lit("</"), "prefix", F.lit(f"{name}>"))
