from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliolake.corpus import Corpus


@pytest.fixture(scope="module")
def corpus(spark, tiny):
    return Corpus(spark, tiny)


def test_edits_are_previewed_and_refused(corpus):
    edited = corpus.replace_text("er", "<>").cache()
    hunks = corpus.diff_preview(edited)
    assert hunks.count() == edited.filter("code is null").count() > 0
    assert {(r.old, r.new) for r in hunks.collect()} == {("er", "<>")}
    assert corpus.diff_preview(corpus.batch_edit([("e", "E"), ("E", "e")])).filter("new = 'x'").count() == 0


def test_one_revision_and_all(corpus):
    key = corpus.revisions().filter("kind = 'delete'").select("revision").first()[0]
    before = corpus.decide_all(True).count()
    assert corpus.accept_revision(key).count() < corpus.reject_revision(key).count()
    assert corpus.decide_all(False).filter("revision is not null").count() == 0 < before


def test_paragraphs_comments_and_tables(corpus):
    one = corpus.get_paragraph(1, "P0")
    assert one.count() == 1 and corpus.list_paragraphs().count() == corpus.enumerate().count()
    assert corpus.insert_paragraph(F.col("idx") == 0, F.lit("new")).count() > corpus.delete_paragraph(F.col("idx") == 0).count()
    comments = corpus.list_comments()
    first = comments.select("id").first()[0]
    assert corpus.get_comment(first).count() == 1 and corpus.delete_comment(first).count() == comments.count() - 1
    assert corpus.table_split_cells(0, 2).count() == corpus.table_insert_col(0).count() == corpus.table_delete_col(0).count()
    assert corpus.table_insert_row(0).count() > corpus.table_delete_row(0).count()
    assert corpus.table_merge_cells(0, 2).filter("code is not null").count() > 0 == corpus.table_merge_cells(0, 2, True).filter("code is not null").count()


def test_review_and_audit(corpus, spark, tmp_path):
    inbox = corpus.review_inbox()
    some = inbox.select("event_id").limit(5).cache()
    after = corpus.review_ack(some)
    assert after.filter("status = 'queued'").count() == inbox.count() - some.count()
    assert corpus.review_preflight().filter("ready = (queued > 0)").count() == 0
    assert {r[0] for r in corpus.review_settlement_plan().select("settlement").distinct().collect()} <= {"settle", "carry-forward", "done", "none"}
    assert corpus.review_state().count() == corpus.review_inbox(True).select("client_id").distinct().count()
    assert corpus.audit_policy().filter("error = 'missing-decision' and decision is not null").count() == 0
    same = corpus.verify_output(corpus.publish(spark.createDataFrame([(1, "x")], "package_id long, source_sha256 string"), f"{tmp_path}/v1"))
    assert {r.status for r in same.collect()} == {"changed", "removed"}
