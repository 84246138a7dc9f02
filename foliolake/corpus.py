"""One object for the questions and edits that an editor's tools ask for, over a whole corpus.

Every method returns a DataFrame (a plan; nothing runs before an action). Edits
don't change anything in place: they return the rows after the edit, to look at
(``diff_preview``), check (``verify_output``) or publish as a new version.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.operators import audit, compare, edits, inventory, review, splices, tables
from foliolake.plans import joins
from foliolake.sources import bindings, docx, shared, word

PK = ["package_id", "idx"]


class Corpus:
    """The documents, comments, tables and review events below a folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _of(self, relation) -> DataFrame:
        return relation(self.spark, self.folder)

    # reading

    def list_paragraphs(self, preview: int = 60) -> DataFrame:
        rows = self._of(bindings.paragraphs)
        return rows.select(*PK, "paragraph_id", F.length("text").alias("chars"), F.left("text", F.lit(preview)).alias("preview"))

    def get_paragraph(self, package_id: int, paragraph_id: str) -> DataFrame:
        return self._of(bindings.paragraphs).filter((F.col("package_id") == package_id) & (F.col("paragraph_id") == paragraph_id))

    def enumerate(self) -> DataFrame:
        """Paragraphs with their counts of leaves and opaque blocks, and whether they can be edited."""
        return inventory.paragraph_inventory(self._of(bindings.leaves))

    def text_views(self) -> DataFrame:
        return inventory.views(self._of(bindings.segments))

    def revisions(self) -> DataFrame:
        return self._of(bindings.revisions)

    def list_comments(self) -> DataFrame:
        return joins.comments(self.spark, self.folder)

    def get_comment(self, comment_id: str) -> DataFrame:
        return self.list_comments().filter(F.col("id") == comment_id)

    def fingerprints(self) -> DataFrame:
        return inventory.fingerprints(self._of(bindings.segments))

    # edits of text

    def replace_text(self, old: str, new: str) -> DataFrame:
        """Paragraphs with ``old`` replaced where it occurs once, and a code where it doesn't."""
        return edits.island_edit(self._of(bindings.paragraphs), old, new)

    def batch_edit(self, replacements: list[tuple[str, str]]) -> DataFrame:
        return self._of(bindings.paragraphs).withColumn("edited", edits.batch_edit(F.col("text"), replacements))

    def insert_paragraph(self, after: Column, text: Column) -> DataFrame:
        return edits.insert_and_delete_paragraphs(self._of(bindings.paragraphs), after, text, F.lit(False))

    def delete_paragraph(self, where: Column) -> DataFrame:
        return edits.insert_and_delete_paragraphs(self._of(bindings.paragraphs), F.lit(False), F.lit(""), where)

    def diff_preview(self, edited: DataFrame) -> DataFrame:
        """The changed paragraphs of a frame with ``text`` and ``edited``: start, old, new."""
        changed = edited.filter(~F.col("text").eqNullSafe(F.col("edited")))
        return changed.select(*PK, edits.trim_diff(F.col("text"), F.col("edited")).alias("d")).select(*PK, "d.*")

    # revisions and comments

    def accept_revision(self, key: str) -> DataFrame:
        return edits.settle(self._of(bindings.segments), True, F.col("revision") == key)

    def reject_revision(self, key: str) -> DataFrame:
        return edits.settle(self._of(bindings.segments), False, F.col("revision") == key)

    def decide_all(self, accept: bool) -> DataFrame:
        return edits.settle(self._of(bindings.segments), accept)

    def delete_comment(self, comment_id: str) -> DataFrame:
        """The comments that are left."""
        return self.list_comments().filter(F.col("id") != comment_id)

    # tables

    def table_insert_row(self, after: int) -> DataFrame:
        return tables.insert_row(self._of(bindings.cell_rows), after)

    def table_delete_row(self, row: int) -> DataFrame:
        return tables.delete_row(self._of(bindings.cell_rows), row)

    def table_insert_col(self, after: int) -> DataFrame:
        return tables.insert_column(self._of(bindings.cell_rows), after)

    def table_delete_col(self, column: int) -> DataFrame:
        return tables.delete_column(self._of(bindings.cell_rows), column)

    def table_merge_cells(self, column: int, span: int, discard_content: bool = False) -> DataFrame:
        return tables.merge_cells(self._of(bindings.cell_rows), column, span, discard_content)

    def table_split_cells(self, column: int, span: int) -> DataFrame:
        return tables.split_cell(self._of(bindings.cell_rows), column, span)

    # review

    def review_inbox(self, acknowledged: bool = False) -> DataFrame:
        return review.inbox(self._of(bindings.review_events), acknowledged)

    def review_state(self) -> DataFrame:
        return review.last_states(self._of(bindings.review_events), "client_id")

    def review_ack(self, event_ids: DataFrame) -> DataFrame:
        """The events with those of ``event_ids`` (event_id) acknowledged."""
        wanted = event_ids.select("event_id").distinct().withColumn("acked", F.lit(True))
        events = self._of(bindings.review_events).join(wanted, "event_id", "left")
        return events.withColumn("status", F.when(F.col("acked") & (F.col("status") == "queued"), "acknowledged").otherwise(F.col("status"))).drop("acked")

    def review_preflight(self) -> DataFrame:
        """Per client: queued events that nothing has been done with, and whether an agent may go on."""
        waiting = ~F.coalesce(F.col("delivery_state").isin("in_progress", "applied", "acknowledged"), F.lit(False))
        queued = F.count_if((F.col("status") == "queued") & waiting)
        return self._of(bindings.review_events).groupBy("client_id").agg(queued.alias("queued"), (queued == 0).alias("ready"))

    def review_settlement_plan(self) -> DataFrame:
        return self._of(bindings.review_events).withColumn("settlement", review.settlement_group())

    # audit, verification, versions

    def audit_scan(self) -> DataFrame:
        return audit.candidates(self._of(bindings.paragraphs), bindings.checked_catalog(self.spark), "[äöüßéèêçñóíá]")

    def audit_policy(self) -> DataFrame:
        return audit.policy_errors(self.audit_scan(), self._of(bindings.decisions))

    def verify_output(self, output: DataFrame) -> DataFrame:
        """How a manifest (package_id, source_sha256) differs from the corpus."""
        return compare.manifest_diff(self._of(bindings.packages), output, "package_id", "source_sha256")

    def publish(self, rows: DataFrame, path: str) -> DataFrame:
        """Writes a new version, which must not exist, and returns it for reading."""
        return shared.publish(rows, path)


class PackageCorpus(Corpus):
    """The same over a folder tree of Word packages. Review events, decisions and catalogs aren't in packages.

    Packages are read once; their items are kept in the shared folder. What can't
    be read is in ``errors``.
    """

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder)
        self.packages = docx.read_packages(spark, folder)
        members = docx.members(self.packages)
        self.errors = members.filter("error is not null").select("package_id", "error")
        self.members = members.filter("error is null")
        self.items = shared.written(word.items(self.members), "items")

    def _of(self, relation) -> DataFrame:
        found = {
            "packages": lambda: self.packages.select("package_id", F.sha2("content", 256).alias("source_sha256")),
            "paragraphs": lambda: word.paragraphs(self.items),
            "segments": lambda: word.segments(self.items),
            "leaves": lambda: word.segments(self.items),
            "revisions": lambda: word.revisions(self.items),
            "cell_rows": self._cell_rows,
        }
        if relation.__name__ not in found:
            raise ValueError(f"packages have no {relation.__name__}")
        return found[relation.__name__]()

    def _cell_rows(self) -> DataFrame:
        cells = word.cells(word.paragraphs(self.items)).withColumn("table_index", F.concat_ws("/T", "package_id", "table_index"))
        rows = F.sort_array(F.collect_list(F.struct("col_index", "text")))
        return cells.groupBy("table_index", "row_index").agg(F.transform(rows, lambda r: r["text"]).alias("cells"))

    def enumerate(self) -> DataFrame:
        return word.paragraphs(self.items).select("package_id", "part", "idx", "paragraph_id", "leaf_count", "opaque_count", "editable")

    def text_views(self) -> DataFrame:
        return inventory.views(word.segments(self.items), separator="")

    def list_comments(self) -> DataFrame:
        anchors = word.comment_anchors(self.items).groupBy("package_id", "id").agg(F.count("*").alias("anchors"))
        both = docx.comment_entries(self.members).join(anchors, ["package_id", "id"], "full_outer")
        return both.select("package_id", "id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("author", "text")], F.coalesce("anchors", F.lit(0)).alias("anchors"))

    def settled_items(self, accept: bool) -> DataFrame:
        """Items after all revisions are settled, anchors kept."""
        return word.settle(self.items, accept)

    # edits of the packages themselves: package_id, content, with all members that an edit leaves alone as they are stored

    @functools.cached_property
    def spans(self) -> DataFrame:
        return shared.written(docx.spans(self.members, splices.WANTED), "spans")

    def edited(self, given: DataFrame, kept: DataFrame | None = None) -> DataFrame:
        """The packages after splices; one whose splices conflict stays as it is."""
        return splices.applied(self.packages, splices.disjoint(given, kept)[0])

    def settled_packages(self, accept: bool) -> DataFrame:
        return self.edited(*splices.settle(self.spans, accept))

    def delete_comment(self, comment_id: str) -> DataFrame:
        """The packages without a comment: its entry, anchors, reference run and extended entry."""
        ids = self.packages.select("package_id", F.lit(comment_id).alias("id"))
        return self.edited(splices.delete_comments(self.spans, ids))

    def track_replacement(self, old: str, new: str, author: str, date: str) -> DataFrame:
        """The packages with a literal replaced as a tracked change wherever a text holds it once."""
        return self.edited(splices.track_replacements(self.spans, old, new, author, date)[0])

    def insert_table_row(self, table: int, after: int) -> DataFrame:
        """The packages with a row of empty cells in one of the body's tables."""
        return self.edited(splices.insert_rows(self.spans, self.packages.select("package_id", F.lit(table).alias("table_index"), F.lit(after).alias("row_index"))))

    def write_packages(self, packages: DataFrame, folder: str) -> DataFrame:
        """Writes packages (package_id, content) as files of a shared folder, each by its task: path and bytes of each.

        A task that runs again writes the same files again; names come from the
        packages' own, below the folder that they were read from.
        """
        named = packages.join(self.packages.select("package_id", "path"), "package_id")
        return docx.write_files(named, folder)
