"""The model's relations from Word packages, typed text, checks and limits, on packages made for their traps."""

from __future__ import annotations

import io
import itertools
import random
import time
import tracemalloc
import unicodedata
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliolake.functions import keys, text
from foliolake.operators import audit, diff, edits, inventory, limits, ranking
from foliolake.plans import packages as plans
from foliolake.sources import bindings, docx, typed, word

REVISED = (
    '<w:document><w:body><w:bookmarkStart w:id="9" w:name="free"/><w:p><w:pPr><w:rPr><w:del w:id="3" w:author="A" w:date="d"/></w:rPr></w:pPr>'
    '<w:r><w:rPr><w:i/><w:b w:val="1"/></w:rPr><w:t>keep </w:t></w:r><w:ins w:id="1" w:author="A"><w:r><w:t>new </w:t></w:r><w:del w:id="2" w:author="B"><w:commentRangeStart w:id="7"/><w:r><w:delText>both</w:delText></w:r></w:del></w:ins>'
    '<w:moveFrom w:id="4"><w:r><w:t>moved</w:t></w:r></w:moveFrom><w:commentRangeEnd w:id="7"/><w:hyperlink r:id="rId5"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>'
    "<w:p><w:r><w:rPr><w:b w:val='1'/><w:rPrChange><w:rPr><w:u/></w:rPr></w:rPrChange></w:rPr><w:t>bold</w:t></w:r></w:p></w:body></w:document>"
)


def package(xml: str, **members: str) -> bytes:
    return docx.write_package({"word/document.xml": xml.encode()} | {name: raw.encode() for name, raw in members.items()})


def rows_of(spark, *contents):
    frame = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in enumerate(contents)], "package_id long, content binary")
    return docx.members(frame)


def test_items_carry_revisions_styles_links_and_anchors():
    found = [(i.item, i.text, [r[:3] for r in i.revisions], i.ref) for i in docx.items_of(REVISED, "document")]
    assert found == [
        ("bookmark-start", "", [], "9"), ("mark", "", [("delete", "3", "A")], None), ("text", "keep ", [], None), ("text", "new ", [("insert", "1", "A")], None),
        ("comment-start", "", [("insert", "1", "A"), ("delete", "2", "B")], "7"), ("text", "both", [("insert", "1", "A"), ("delete", "2", "B")], None),
        ("text", "moved", [("move_from", "4", "")], None), ("comment-end", "", [], "7"), ("text", "link", [], "rId5"), ("text", "bold", [], None),
    ]
    styles = {i.text: i.style for i in docx.items_of(REVISED, "document") if i.item == "text"}
    assert styles["keep "] == "i/;b val=1/" and styles["bold"] == "b val=1/" and styles["new "] == ""


def test_segments_and_views_of_nested_revisions(spark):
    items = word.items(rows_of(spark, package(REVISED))).cache()
    segments = {r.text: r for r in word.segments(items).collect()}
    assert {t: (r.in_original, r.in_final) for t, r in segments.items()} == {"keep ": (True, True), "new ": (False, True), "both": (False, False), "moved": (True, False), "link": (True, True), "bold": (True, True)}
    assert segments["both"].kind == "delete" and segments["both"].start == 9 and segments["link"].k == 4
    revisions = {r.w_id: r for r in word.revisions(items).collect()}
    assert revisions["1"].text == "new both" and revisions["2"].text == "both"
    assert (revisions["3"].reason, revisions["3"].scope, revisions["3"].editable) == ("paragraph-mark-revision", "paragraph-mark", False)


def test_settling_drops_marks_and_keeps_anchors(spark):
    items = word.items(rows_of(spark, package(REVISED))).cache()
    left = lambda accept: [(r.item, r.text or r.ref) for r in word.settle(items, accept).orderBy("position").collect()]
    assert left(True) == [("bookmark-start", "9"), ("text", "keep "), ("text", "new "), ("comment-start", "7"), ("comment-end", "7"), ("text", "link"), ("text", "bold")]
    assert left(False) == [("bookmark-start", "9"), ("text", "keep "), ("comment-start", "7"), ("text", "moved"), ("comment-end", "7"), ("text", "link"), ("text", "bold")]
    again = word.settle(word.settle(items, True), False)
    assert again.count() == 7 and again.filter(F.size("revisions") > 0).count() == 0


def test_comments_go_with_anchors_and_extended_entries(spark):
    comments = '<w:comments><w:comment w:id="7" w:author="A"><w:p w14:paraId="0A"><w:r><w:t>one</w:t></w:r></w:p><w:p w14:paraId="0B"><w:r><w:t> two</w:t></w:r></w:p></w:comment><w:comment w:id="8"/></w:comments>'
    members = rows_of(spark, package(REVISED, **{"word/comments.xml": comments, "word/commentsExtended.xml": '<x><w15:commentEx w15:paraId="0B" w15:done="1"/><w15:commentEx w15:paraId="0C" w15:done="0"/></x>'})).cache()
    entries = docx.comment_entries(members)
    assert sorted((r.id, r.author, r.text, r.para_id) for r in entries.collect()) == [("7", "A", "one two", "0B"), ("8", "", "", None)]
    items = word.items(members)
    left, kept, extended = word.delete_comments(items, entries, docx.extended_entries(members), entries.filter("id = '7'"))
    assert left.filter(F.col("item").startswith("comment-")).count() == 0 and [r.id for r in kept.collect()] == ["8"] and [r.para_id for r in extended.collect()] == ["0C"]
    assert left.count() == items.count() - 2 and [x.count() for x in word.delete_comments(items, entries, docx.extended_entries(members))[1:]] == [0, 0]


def test_parts_are_read_in_order_and_cells_found(spark):
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    part = lambda t: f"<x><w:p><w:r><w:t>{t}</w:t></w:r></w:p></x>"
    members = rows_of(spark, package(f"<w:document>{table}</w:document>", **{"word/footnotes.xml": part("note"), "word/header2.xml": part("two"), "word/header1.xml": part("one"), "word/footer1.xml": part("foot"), "word/other.xml": part("no")}))
    paragraphs = word.paragraphs(word.items(members)).cache()
    assert [r.text for r in paragraphs.orderBy("idx").collect()] == ["a", "b", "one", "two", "foot", "note"]
    assert [(r.table_index, r.row_index, r.col_index, r.text) for r in word.cells(paragraphs).collect()] == [(0, 0, 0, "a\nb")]
    ids = spark.createDataFrame([("header2.T1.R2.C3.P4",), ("B2.P0",), ("S1.P7",), ("P12",)], "p string").select(*keys.parse_paragraph_id(F.col("p"))).collect()
    assert [tuple(r) for r in ids] == [("header2", 1, 2, 3, None, None, 4), ("document", None, None, None, 2, None, 0), ("document", None, None, None, None, 1, 7), ("document", None, None, None, None, None, 12)]


def test_checks_stop_at_the_first_failure(spark):
    lines = [f"line {k} of text" for k in range(6)]
    good = docx.document_package(lines, "a")
    frame = spark.createDataFrame([(1, bytearray(good), None), (2, bytearray(good), "no-zip"), (3, bytearray(good), "no-comments"), (4, bytearray(good), "cut-document"), (5, None, None)], "package_id long, content binary, damage string")
    damaged = frame.filter("package_id < 5").select("package_id", "content", "damage")
    broken = docx.damaged(damaged, F.col("damage")).unionByName(frame.filter("package_id = 5").select("package_id", "content"))
    results = {(r.package_id, r.check): r.result for r in plans.checked(broken).collect()}
    assert [results[k, c] for k in range(1, 6) for c in ("open", "well-formed", "anchors")] == ["pass", "pass", "pass", "fail", "not-run", "not-run", "pass", "pass", "fail", "pass", "fail", "not-run", "fail", "not-run", "not-run"]


def test_limits_are_inclusive_and_cover_every_dimension(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive, pytest.warns(UserWarning):
        archive.writestr("word/document.xml", "<w:document><w:body><w:p><w:r><w:t>" + "x" * 5000 + "</w:t></w:r></w:p></w:body></w:document>")
        archive.writestr("word/a.xml", "<a/>")
        archive.writestr("word/a.xml", "<a/>")
    frame = spark.createDataFrame([(1, bytearray(out.getvalue())), (2, bytearray(b"no zip"))], "package_id long, content binary")
    stats = docx.package_stats(frame).withColumns({"missing_targets": F.lit(1).cast("long"), "cycles": F.lit(0).cast("long")}).cache()
    one = stats.filter("valid").first()
    assert (one.zip_parts, one.duplicate_entries, one.max_text_node_bytes, one.xml_nesting_depth) == (3, 1, 5000, 5)
    tight = {"docx_package_mib": 1 / limits.MIB, "uncompressed_xml_mib": 1 / limits.MIB, "zip_parts": 2, "max_leaf_island_bytes": 4999, "xml_nesting_depth": 4, "compression_ratio_max": 1}
    found = {(r.package_id, r.dimension) for r in limits.violations(stats, tight).collect()}
    assert found == {(1, d) for d, _, _ in limits.dimensions(tight)} | {(2, "package-validity")} and len(found) == 10
    at_limit = {"docx_package_mib": 1, "uncompressed_xml_mib": 1, "zip_parts": 3, "max_leaf_island_bytes": 6000, "xml_nesting_depth": 5, "compression_ratio_max": 1000}
    assert {r.dimension for r in limits.violations(stats.filter("valid"), at_limit).collect()} == {"duplicate-entries", "relationship-cycle"}


def test_typed_text_round_trip_and_errors(spark):
    items = word.items(rows_of(spark, package(REVISED))).filter("item <> 'mark' and paragraph_id is not null")
    last = F.try_element_at("revisions", F.lit(-1))
    given = items.withColumns({"style_id": keys.style_id(F.col("style")), "kind": last["kind"], "w_id": last["w_id"]}).cache()
    back = typed.parse(typed.serialize(given)).cache()
    key = lambda rows: sorted((r.paragraph_id, r.item, r.text, r.kind or "", r.w_id or "") for r in rows.collect())
    assert key(back) == key(given) and back.filter("error is not null").count() == 0
    bad = ["no header", '<!--@typed schema="1"-->\n\n<!--@p id="P0" base="s"-->\n<span data-s="x">open', '<!--@typed schema="1"-->\n\n<!--@p id="P0" base="s"-->\n<docx-revision id="1" kind="what">x</docx-revision>', '<!--@typed schema="1"-->\n\n<!--@p id="P0" base="s"-->\na\n\n<!--@p id="P0" base="s"-->\nb']
    assert typed.parse(spark.createDataFrame(list(enumerate(bad)), "package_id long, typed string")).filter("error is not null").count() == 4


def test_a_folder_of_packages_is_a_corpus(spark, tmp_path):
    from foliolake.corpus import PackageCorpus

    lines = [f"line {k} has some words" for k in range(12)]
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.docx").write_bytes(docx.document_package(lines, "one"))
    (tmp_path / "deep" / "b.docx").write_bytes(docx.document_package(lines[:5], "two"))
    (tmp_path / "c.docx").write_bytes(b"broken")
    corpus = PackageCorpus(spark, str(tmp_path))
    assert corpus.errors.count() == 1 and corpus.enumerate().filter("not editable").count() == 3
    views = {(r.original, r.final) for r in corpus.text_views().collect()}
    assert ("line4 has some words", "line4") not in views and ("linehas some words", "line4") in views
    assert corpus.revisions().filter("reason is null").count() == 6 and corpus.list_comments().filter("anchors = 3").count() == 2
    assert {tuple(r.cells) for r in corpus.table_insert_col(0).collect()} == {("line", "", "1 has some words"), ("line", "", "7 has some words")}
    edited = corpus.replace_text("line 0 has", "first has").cache()
    assert [(r.old, r.new) for r in corpus.diff_preview(edited).collect()] == [("line 0", "first"), ("line 0", "first")]
    assert corpus.decide_all(True).filter("kind is not null").count() == 0 and corpus.settled_items(True).filter("item = 'bookmark-start'").count() == 3
    with pytest.raises(ValueError):
        corpus.review_inbox()


# diffs, clusters, offsets, ranks


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), max_size=60), st.lists(st.sampled_from("abcdefg"), max_size=60))
def test_hunks_turn_one_side_into_the_other(a, b):
    out, at = [], 0
    for op, i, j, k, m in diff.hunks(a, b):
        assert {"insert": i == j and k < m, "delete": i < j and k == m, "replace": i < j and k < m}[op] and i >= at
        out += a[at:i] + b[k:m]
        at = j
    assert out + a[at:] == b


def test_long_diffs_are_quick_and_small():
    words = [f"w{k % 997}-{k // 7}" for k in range(60_000)]
    other = [w for k, w in enumerate(words) if k % 11 != 7]
    found = list(diff.hunks(words, other))
    assert sum(j - i for _, i, j, _, _ in found) == len(words) - len(other) and {h[0] for h in found} == {"delete"}
    assert [h[0] for h in diff.hunks(["x"] * 30_000 + ["y"], ["z"] + ["x"] * 30_000)] == ["insert", "delete"]
    rng = random.Random(1)
    a, b = ([str(rng.randrange(1000)) for _ in range(5000)] for _ in range(2))
    began = time.process_time()
    tracemalloc.start()
    diff.matched(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 << 20 and time.process_time() - began < 20


def longest(a: list, b: list) -> int:
    """The length of a longest common subsequence, by a full table."""
    row = [0] * (len(b) + 1)
    for x in a:
        above = row[:]
        for j, y in enumerate(b):
            row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("few", [0, 3, 48])
def test_diffs_are_shortest_either_way(few, monkeypatch):
    monkeypatch.setattr(diff, "FEW", few)
    rng = random.Random(few)
    for _ in range(800):
        letters = "abcdefgh"[: rng.randint(1, 8)]
        a, b = (["".join(rng.choice(letters)) for _ in range(rng.randint(0, 30))] for _ in range(2))
        pairs = diff.matched(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(pairs))
        assert len(pairs) == longest(a, b)


def test_hunks_carry_styles_and_rebuild(spark):
    views = spark.createDataFrame([(1, 0, "the old cat sat  here", "a cat sat  there now"), (1, 1, "same", "same"), (1, 2, "x ", "")], "package_id long, idx long, a string, b string")
    found = diff.word_hunks(views, "a", "b").cache()
    assert {(r.idx, r.rebuilt) for r in diff.rebuilt(views, found, "a").collect()} == {(0, "a cat sat  there now"), (2, "")}
    words = views.select("package_id", "idx", F.posexplode(F.split("a", " ")).alias("place", "text")).withColumn("style_id", F.concat(F.lit("s"), F.col("place") % 2))
    records = {(r.idx, r.start): (r.op, r.source_styles) for r in diff.hunk_records(found, words).collect()}
    assert records[0, 0] == ("replace", ["s0", "s1"]) and records[0, 5] == ("replace", ["s1"])


def clusters(t: str) -> list[str]:
    """The rules, character by character."""
    out, regional = [], 0
    flag = lambda c: 0x1F1E6 <= ord(c) <= 0x1F1FF
    for k, c in enumerate(t):
        previous = t[k - 1] if k else ""
        joined = k and (previous == "\r" and c == "\n" or unicodedata.category(c) in ("Mn", "Me", "Mc") or "‍" in (previous, c) or flag(previous) and flag(c) and regional % 2 == 1)
        regional = regional + 1 if flag(c) else 0
        if joined:
            out[-1] += c
        else:
            out.append(c)
    return out


def test_clusters_equal_the_rules(spark):
    texts = ["", "é🇩🇪👩‍👩‍👧x", "🇩🇪🇫", "\r\n\n\r", "a‍b", "🇩́🇪", "कि", "👍‍‍🇩🇪🇫", "́a", "x‍\r\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.graphemes(F.col("t")).alias("g")).collect()
    assert {r.t: r.g for r in rows} == {t: clusters(t) for t in texts}


def test_clusters_of_long_texts(spark):
    marks, joined, flags = "a" + "\u0301" * 1_000_000, "a\u200d" * 200_000, "🇩🇪" * 100_001 + "🇩"
    frame = spark.createDataFrame([(marks,), (joined,), (flags,), (None,)], "t string")
    assert [r.n for r in frame.select(text.grapheme_count(F.col("t")).alias("n")).collect()] == [1, 1, 100_002, None]
    assert [clusters(t) == [t[a:b] for a, b in itertools.pairwise([*text.cluster_starts(t).tolist(), len(t)])] for t in ("a" + "\u0301" * 3000, "👩\u200d" * 999 + "🇩🇪🇩")] == [True, True]


def test_audit_of_a_line_full_of_hits_is_linear(spark):
    frame = spark.createDataFrame([(1, 0, "P0", "é" * 100_000), (1, 1, "P1", "no hit"), (2, 0, "P0", "xäyéz")], "package_id long, idx long, paragraph_id string, text string")
    began = time.time()
    found = audit.candidates(frame, bindings.catalog(spark), "[äé]")
    assert found.agg(F.count("*"), F.max("visible_offset"), F.count_distinct("visible_offset", "package_id")).first()[:] == (100_002, 99_999, 100_002)
    assert time.time() - began < 60
    assert [(r.visible_offset, r.source, r.context, r.occurrence_id) for r in found.filter("package_id = 2").orderBy("visible_offset").collect()] == [(1, "ä", "xäyéz", "P0-V0001"), (3, "é", "xäyéz", "P0-V0002")]


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 1000, 40_000])
def test_word_starts_are_running_sums(spark, n):
    words = [("ä" * (k % 5)) for k in range(n)]
    at, expected = 0, []
    for w in words:
        expected.append(at)
        at += len(w) + 1
    assert spark.createDataFrame([(" ".join(words),)], "t string").select(text.word_starts(F.split("t", " "))).first()[0] == expected


def test_ranks_and_percentiles_without_gathering(spark):
    rows = [(("a", "b", None)[k % 3], (k * 37) % 100) for k in range(600)] + [("a", 5)] * 50
    frame = spark.createDataFrame(rows, "g string, v long").repartition(5)
    found = ranking.ranked_within(frame, "g", ["v"]).collect()
    for g in ("a", "b", None):
        mine = sorted((r.rank, r.v) for r in found if r.g == g)
        assert [k for k, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for h, v in rows if h == g)
    exact = {r.g: (r.m, r.p) for r in frame.groupBy("g").agg(F.expr("percentile_disc(0.5) within group (order by v)").alias("m"), F.expr("percentile_disc(0.95) within group (order by v)").alias("p")).collect()}
    assert {r.g: (r.m, r.p) for r in ranking.percentiles(frame, "g", "v", {"m": 0.5, "p": 0.95}).collect()} == exact


def test_quoted_ends_of_html_tags(spark):
    page = "<p title=\"a > b\" x='<i>'>One</p><br/>"
    found = spark.createDataFrame([(page,)], "html string").select(F.regexp_extract_all("html", F.lit(bindings.TAG), 0)).first()[0]
    assert found == ["<p title=\"a > b\" x='<i>'>", "</p>", "<br/>"]


def test_drafts_are_committed_refused_and_reverted(spark):
    base = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "package_id long, idx int, text string")
    of = lambda t: keys.fingerprint12(F.lit(t))
    drafts = base.filter("idx < 2").select("package_id", "idx", F.lit("new").alias("draft"), F.when(F.col("idx") == 0, of("a")).otherwise(of("old")).alias("base_fingerprint"))
    after = edits.commit(base, drafts).orderBy("idx")
    assert [(r.text, r.code) for r in after.collect()] == [("new", "committed"), ("b", "stale-draft"), ("c", None)]
    drafted = after.filter("idx <> 2").select("package_id", "idx", "text").union(spark.createDataFrame([(1, 7, "added")], "package_id long, idx int, text string")).cache()
    records = edits.record(base, drafted).cache()
    assert sorted((r.idx, r.kind, r.start, r.old, r.new) for r in records.collect()) == [(0, "change", 0, "a", "new"), (2, "delete", 0, "c", ""), (7, "add", 0, "", "added")]
    assert [(r.text, r.reverted) for r in edits.undo(drafted, records).orderBy("idx").collect()] == [("a", True), ("b", False), ("c", True)]
    changed = drafted.withColumn("text", F.when(F.col("idx") == 0, "other").otherwise(F.col("text")))
    assert [(r.text, r.reverted, r.code) for r in edits.undo(changed, records).orderBy("idx").collect()] == [("other", False, "moved"), ("b", False, None), ("c", True, None)]


# odd rows of the bindings


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, "a" * 50_000, "en", "s"), (4, "w " * 20_000, "en", "s"), (5, "x\ny\n\n", "en", "s"), (6, "x\ny\n\n", "en", "s"), (7, "😀 é", "en", "s"), (8, "one two three four five six seven eight", "en", "s")]
    for name, data in (("full", rows), ("empty", [])):
        frame = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").withColumns({"package_id": F.lit("clash"), "idx": F.lit(0), "k": F.lit("x"), "start": F.lit(1)})
        (folder / name).mkdir()
        frame.coalesce(1).write.parquet(f"{folder}/{name}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["flagship_package_summary", "s8_projection", "a2_text_views", "a5_base_style", "a19_paragraph_fingerprint", "w4_revision_ancestry", "w6_merged_runs", "d3_rebuilt_texts", "d4_trim_diff", "s5_body_paragraphs", "s13_typed_round_trip", "d10_settled_packages", "f10_resource_limits", "x6_codepoints", "x10_grapheme_clusters"])
def test_odd_texts_and_empty_tables(name, spark, odd_tables):
    from foliolake.plans import catalog

    assert catalog.QUERIES[name](spark, f"{odd_tables}/full").count() > 0
    assert catalog.QUERIES[name](spark, f"{odd_tables}/empty").count() == 0


def test_every_leaf_of_an_odd_text_is_there(spark, odd_tables):
    leaves = bindings.leaves(spark, f"{odd_tables}/full").groupBy("package_id").agg(F.count("*").alias("n"), F.max("end").alias("end")).collect()
    assert {r.package_id: (r.n, r.end) for r in leaves} == {1: (1, 0), 2: (1, 0), 3: (1, 50_000), 4: (20_001, 40_000), 5: (4, 1), 6: (4, 1), 7: (2, 3), 8: (8, 39)}
    assert inventory.views(bindings.segments(spark, f"{odd_tables}/full")).count() == 14
