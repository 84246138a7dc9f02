"""Edits of paragraphs and segments, each as a transform of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.functions.keys import fingerprint12
from foliolake.functions.text import let, occurrences, replace_at, sub

PK = ["package_id", "idx"]


def island_edit(rows: DataFrame, old: str, new: str, text: str = "text") -> DataFrame:
    """Replaces ``old`` where it occurs exactly once in a text; else the text stays and a code says why."""
    n = occurrences(F.col(text), old)
    code = F.when(n == 0, "not-found").when(n > 1, "ambiguous")
    place = F.instr(text, old) - 1
    edited = F.when(n == 1, replace_at(F.col(text), place, F.lit(old), F.lit(new))).otherwise(F.col(text))
    return rows.withColumns({"edited": edited, "code": code})


def batch_edit(text: Column, edits: list[tuple[str, str]]) -> Column:
    """Applies literal replacements one after the other."""
    pairs = F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in edits])
    return F.aggregate(pairs, text, lambda t, e: F.replace(t, e["old"], e["new"]))


def survives(accept: bool, chosen: Column | None = None, kind: Column | None = None) -> Column:
    """Whether a segment is left after its revision is settled (all are, or where ``chosen``)."""
    kind = F.col("kind") if kind is None else kind
    gone = kind.isin(*(("delete", "move_from") if accept else ("insert", "move_to")))
    settled = kind.isNotNull() if chosen is None else F.coalesce(chosen, F.lit(False))
    return ~F.coalesce(gone & settled, F.lit(False))


def settle(segments: DataFrame, accept: bool, chosen: Column | None = None) -> DataFrame:
    """Settles revisions (all, or where ``chosen``): what the decision removes goes, the rest becomes plain text."""
    settled = F.col("kind").isNotNull() if chosen is None else F.coalesce(chosen, F.lit(False))
    kept = segments.filter(survives(accept, chosen))
    clear = lambda c: F.when(~F.coalesce(settled, F.lit(False)), F.col(c)).alias(c)
    return kept.select(*[clear(c) if c in ("kind", "revision", "w_id") else c for c in segments.columns])


def replacement(text: Column, new: Column) -> Column:
    """The steps of a tracked replacement: a deletion and, after it, an insertion."""
    return F.array(F.struct(F.lit(0).alias("step"), F.lit("delete").alias("op"), text.alias("t")), F.struct(F.lit(1).alias("step"), F.lit("insert").alias("op"), new.alias("t")))


def track_replacements(leaves: DataFrame, chosen: Column, new: Column, recorded: int = 120) -> DataFrame:
    """A replacement as a deletion and, after it, an insertion; texts are recorded up to so many characters."""
    rows = leaves.filter(chosen).select(*PK, "k", F.explode(replacement(F.col("text"), new)).alias("p"))
    order = Window.partitionBy("package_id").orderBy("idx", "k", "step")
    return rows.select(*PK, "k", "p.step", "p.op", F.left("p.t", F.lit(recorded)).alias("text")).withColumn("w_id", (F.row_number().over(order) - 1).cast("long"))


def commit(base: DataFrame, drafts: DataFrame) -> DataFrame:
    """The next version of paragraphs (package_id, idx, text): drafts (package_id, idx, draft, base_fingerprint) take effect.

    A draft made of a text that has changed since is refused; its paragraph stays
    as it is, and ``code`` says so.
    """
    both = base.select(*PK, "text").join(drafts.select(*PK, "draft", "base_fingerprint"), PK, "left")
    stale = F.col("base_fingerprint") != fingerprint12(F.col("text"))
    code = F.when(F.col("draft").isNotNull(), F.when(stale, "stale-draft").otherwise("committed"))
    return both.select(*PK, F.when(code == "committed", F.col("draft")).otherwise(F.col("text")).alias("text"), code.alias("code"))


def record(base: DataFrame, drafted: DataFrame) -> DataFrame:
    """What undoes a draft: for each paragraph that was changed, added or deleted, the place, what stands there and what stood there before.

    ``kind`` is change, add or delete; an unchanged paragraph has no record.
    """
    both = base.select(*PK, F.col("text").alias("was")).join(drafted.select(*PK, F.col("text").alias("now")), PK, "full_outer")
    kind = F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "delete").otherwise("change")
    rows = both.filter(~F.col("was").eqNullSafe(F.col("now"))).withColumn("kind", kind)
    whole = F.struct(F.lit(0).cast("long").alias("start"), F.coalesce("was", F.lit("")).alias("old"), F.coalesce("now", F.lit("")).alias("new"))
    return rows.select(*PK, "kind", F.when(F.col("kind") == "change", trim_diff(F.col("was"), F.col("now"))).otherwise(whole).alias("d")).select(*PK, "kind", "d.*")


def undo(drafted: DataFrame, records: DataFrame) -> DataFrame:
    """Paragraphs without what a record says was done: its changes are taken back where they stand, added ones go, deleted ones come back.

    ``reverted`` says which; a paragraph in which the recorded text no longer stands at its place is left as it is, with the code moved.
    """
    both = drafted.select(*PK, "text").join(records, PK, "full_outer").filter("kind is null or kind <> 'add'")
    stands = sub(F.col("text"), F.col("start"), F.col("start") + F.length("new")) == F.col("new")
    code = F.when((F.col("kind") == "change") & ~stands, "moved")
    text = F.when(F.col("kind") == "delete", F.col("old")).when((F.col("kind") == "change") & stands, replace_at(F.col("text"), F.col("start").cast("int"), F.col("new"), F.col("old"))).otherwise(F.col("text"))
    return both.select(*PK, text.alias("text"), (F.col("kind").isNotNull() & code.isNull()).alias("reverted"), code.alias("code"))


def renumber(rows: DataFrame, partition: list[str], order: list, name: str) -> DataFrame:
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1).cast("long"))


def insert_and_delete_paragraphs(paragraphs: DataFrame, insert_after: Column, text: Column, delete: Column) -> DataFrame:
    """Paragraphs after insertions (which inherit from the one before) and deletions, numbered anew."""
    kept = paragraphs.filter(~delete).select("package_id", "idx", F.lit(0).alias("sub"), "text", F.lit(None).cast("string").alias("inherits"))
    new = paragraphs.filter(insert_after).select("package_id", "idx", F.lit(1).alias("sub"), text.alias("text"), "paragraph_id")
    rows = kept.unionByName(new.withColumnRenamed("paragraph_id", "inherits"))
    return renumber(rows, ["package_id"], ["idx", "sub"], "new_idx").select("package_id", "new_idx", "text", "inherits")


def trim_diff(before: Column, after: Column) -> Column:
    """start, old, new: what is left of two texts without their common start and end. Equal texts are not looked into."""

    def common(a: Column, b: Column) -> Column:
        same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        return let(F.array_position(same, False), lambda first: F.when(first == 0, F.size(same)).otherwise(first - 1))

    def rest(a: Column, b: Column, head: Column) -> Column:
        left = lambda x: F.reverse(F.slice(x, head + 1, F.size(x)))
        return let(common(left(a), left(b)), lambda tail: parts(a, b, head, tail))

    def parts(a: Column, b: Column, head: Column, tail: Column) -> Column:
        middle = lambda t, x: F.substring(t, head + 1, F.size(x) - head - tail)
        return F.struct(head.cast("long").alias("start"), middle(before, a).alias("old"), middle(after, b).alias("new"))

    chars = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ""))
    same = F.struct(F.length(before).cast("long").alias("start"), F.lit("").alias("old"), F.lit("").alias("new"))
    differing = let(chars(before), lambda a: let(chars(after), lambda b: let(common(a, b), lambda head: rest(a, b, head))))
    return F.when(before == after, same).otherwise(differing)
