"""HTML extraction and WARC fixity."""

from __future__ import annotations

import gzip
import html
import re
import time

import pytest
from pyspark.sql import functions as F

from foliolake.llm import html_extract, warc_fixity
from foliolake.llm.storage import table, written

LONG = "It is the story of a house in the town and of all that was there for them when they had been away, so it has more to say than this one line of it can hold in any way at all."


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        (f"<body><nav>Menu</nav><article><h1>Title</h1><p>{LONG}<p>Short.</article><footer>c</footer>", f"Title {LONG} Short."),
        ("<article><p>Tom &amp; J&eacute;r&#244;me &lt;b&gt; &am</p></article>", "Tom & Jérôme <b> &am"),
        ("<article>One<br>two\n\n three<div>four</div></article>", "One two three four"),
        (f"<body><div class='cookie-notice'>{LONG}</div><div><p>{LONG}</p><p>Yes.</p></div><div id=comments><p>{LONG}</p></div></body>", f"{LONG} Yes."),
        (f"<main><p>{LONG}</p><aside>{LONG}</aside><form><input value='>'>Go</form><script>if (a < b) '</main>';</script><p>End.</p></main>", f"{LONG} End."),
        (f"<article><p>{LONG}</p><ul><li><a href=x>One</a><li><a href=y>Two</a></ul><section class=comments><p>{LONG}</p></section></article>", None),
        (f"<body class='has-sidebar'><div class='layout-no-ads'><div id=header>{LONG}</div><div class='site-header'>{LONG}</div><div class=content><p>{LONG}</p></div><div class='right-sidebar'>{LONG}</div></div>", LONG),
        (f"<main><header><h1>Head</h1></header><p>{LONG}</p><div class=related-posts><p>{LONG}</p></div></main><div role=alert>{LONG}</div>", f"Head {LONG}"),
        ("<article><p>Cut off <a href='x", "Cut off <a href='x"),
        (f"<article><p>{LONG}</p><!-- <p>not this</p> --><style>p{{}}</style><p hidden>nor this</p></article>", LONG),
    ],
)
def test_cases(page, expected):
    found = html_extract.extract(page)
    if expected is None:
        assert found.startswith(LONG) and found.count(LONG) == 1
    else:
        assert found == expected


def test_query_returns_whole_articles(spark, tiny):
    pages = {r.page_id: r.html for r in table(spark, tiny, "pages").collect()}
    rows = html_extract.op9_html_extract(spark, tiny).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert r.n_chars == len(r.text)


def test_density_and_neighbours_decide_without_article_tags(spark, tiny):
    pages = [r.html for r in table(spark, tiny.replace("sf0.001", "sf0.01"), "pages").collect()]
    plain = [re.sub(r"<(/?)article\b", r"<\1div", page) for page in pages]
    same = sum(html_extract.extract(a) == html_extract.extract(b) for a, b in zip(pages, plain, strict=True))
    assert same >= 0.98 * len(pages)


LINKS = "".join(f"<a href=/{k}>Section number {k} of the site</a> " for k in range(12))
LISTED = "Lorem Dolor Amet Consectetur Adipiscing Elit Tempor Incididunt Labore Dolore Magna Aliqua Minim Veniam Nostrud Exercitation Ullamco Laboris Nisi"


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (f"<div>{LINKS}</div><div><h1>Title</h1><p>{LONG}</p><p>Yes.</p></div><div>{LISTED}</div><div>Contact</div>", f"Title {LONG} Yes."),
        (f"<div><p>{LONG}</p><p>{LISTED[:130]}</p><p>{LONG}</p></div>", f"{LONG} {LISTED[:130]} {LONG}"),
        (f"<p>Intro</p><p>{LINKS}</p><p>After links</p><p>near</p><p>{LONG}</p>", f"near {LONG}"),
        (f"<article><p>{LONG}</p></article><div>{LONG}</div><div>Share this</div>", LONG),
        ("<article></article><div><p>Only this.</p></div>", "Only this."),
        (f"<head><meta charset=utf-8><title>T</title><body><p>{LONG}</p></body>", LONG),
        (f"<p>{LISTED}</p>", LISTED),
    ],
)
def test_block_rules(page, expected):
    assert html_extract.extract(page) == expected


@pytest.mark.parametrize("page", ["<div " * 80_000, "<div " * 80_000 + ">", '<b ">" ' * 60_000, "<div>" * 40_000 + "</x>" * 40_000, "<a b='x\">" * 40_000, "<script>" * 50_000, "<!--" * 100_000, "</" * 200_000, '<x y="' * 60_000, "<a<" * 130_000 + ">"])
def test_broken_markup_takes_time_in_proportion(page):
    began = time.process_time()
    html_extract.extract(page)
    assert time.process_time() - began < 2


def test_quoted_ends_of_tags():
    assert html_extract.extract('<p title="a > b" lang=\'x>y\'>One</p><p title="5>Two</p>') == "One Two"


def test_extraction_of_odd_rows(spark):
    frame = spark.createDataFrame([(1, None, None), (1, "u", ""), (2, "u", "<p>" * 5000 + "x"), (None, "u", "<article>" + "<p>word</p>" * 20_000)], "page_id long, url string, html string")
    rows = html_extract.extract_pages(frame.withColumn("text", F.lit(1))).collect()
    assert sorted(r.n_chars for r in rows)[:2] == [0, 0] and max(r.n_chars for r in rows) == 99_999
    assert html_extract.extract_pages(frame.limit(0)).count() == 0


def test_fixity_equals_sql(spark, tiny, against_sql):
    against_sql(spark, warc_fixity.op1_warc_fixity, warc_fixity.ORACLE_SQL, tiny)


def _leaves(spark, digests):
    rows = [(f, k, 10 * k, 10, d) for f, k, d in digests]
    return written(spark.createDataFrame(rows, "file long, leaf long, record_offset long, record_length long, sha256 string"), "leaves")


def test_audit_finds_exactly_the_damage(spark):
    good = [(f, k, f"{f}-{k}") for f in (0, 1, 2) for k in range(300)]
    bad = [(f, k, "rot" if (f, k) in {(0, 17), (2, 299)} else d) for f, k, d in good if (f, k) != (1, 299)] + [(3, 0, "new")]
    ours, theirs = (written(warc_fixity.merkle_tree(_leaves(spark, x)), "tree") for x in (good, bad))
    found = {(r.file, r.node, r.status) for r in warc_fixity.audit(ours, theirs).collect()}
    assert found == {(0, 17, "corrupt"), (2, 299, "corrupt"), (1, 299, "missing"), (3, 0, "extra")}
    assert warc_fixity.audit(ours, ours).count() == 0


def test_fixity_of_odd_rows(spark):
    frame = spark.createDataFrame([(1, None, None), (1, "u", "x"), (1, "u", "x"), (None, "u", "ü" * 1000), (-5, "v", "")], "page_id long, url string, html string").withColumn("record", F.lit(1))
    rows = warc_fixity.audit_pages(frame).collect()
    assert len(rows) == 5 and sorted(r.record_no for r in rows) == list(range(5)) and {r.warc_file for r in rows} == {0}
    assert [r.page_id for r in sorted(rows, key=lambda r: r.record_no)] == [None, -5, 1, 1, 1]
    assert warc_fixity.audit_pages(frame.limit(0)).count() == 0


def test_pages_without_an_id_fill_files_like_others(spark, against_sql, tmp_path):
    n = 2 * warc_fixity.RECORDS_PER_FILE + 10
    pages = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("html"))
    pages.coalesce(1).write.parquet(f"{tmp_path}/p")
    next((tmp_path / "p").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    against_sql(spark, warc_fixity.op1_warc_fixity, warc_fixity.ORACLE_SQL, str(tmp_path))


def test_archives_are_audited_file_by_file(spark, tmp_path):
    record = lambda k, body: f"WARC/1.1\r\nWARC-Target-URI: u{k}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    for side in ("ours", "theirs"):
        (tmp_path / side).mkdir()
        for name in "ab":
            rows = [record(k, "rot!" if (side, name, k) == ("theirs", "b", 33) else "body") for k in range(40)]
            (tmp_path / side / f"{name}.warc.gz").write_bytes(b"".join(map(gzip.compress, rows)))
    trees = []
    for side in ("ours", "theirs"):
        leaves = warc_fixity.leaves_of(warc_fixity.read_warc(spark, str(tmp_path / side)))
        trees.append(warc_fixity.merkle_tree(written(leaves.withColumn("file", F.element_at(F.split("file", "/"), -1)), "leaves")))
    assert [(r.file, r.node, r.status) for r in warc_fixity.audit(*trees).collect()] == [("b.warc.gz", 33, "corrupt")]


def test_large_files_are_read_in_pieces(tmp_path, monkeypatch):
    from pyarrow import fs

    monkeypatch.setattr(warc_fixity, "MOST_RECORD", 1 << 20)
    record = lambda k, n: f"WARC/1.1\r\nWARC-Target-URI: u{k}\r\nContent-Length: {n}\r\n\r\n".encode() + b"x" * n + b"\r\n\r\n"
    raw = b"".join(record(k, n) for k, n in enumerate([10, 700_000, 3_000_000, 0, 900_000]))
    (tmp_path / "a.warc").write_bytes(raw)
    rows = list(warc_fixity._records(warc_fixity.PlainBytes(fs.LocalFileSystem().open_input_file(str(tmp_path / "a.warc")))))
    assert b"".join(r[1] for r in rows) == raw and max(len(r[1]) for r in rows) < 3 << 20
    assert [r[2] for r in rows if not r[3]] == ["u0", "u1", "u3", "u4"]


def test_warc_files_are_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<p>ä</p>"), (2, "http://b", "")], "page_id long, url string, html string")
    raw = "".join(r.record for r in pages.select(warc_fixity.render(F.col("page_id"), F.col("url"), F.col("html")).alias("record")).collect()).encode()
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(raw))
    rows = warc_fixity.read_warc(spark, str(tmp_path)).orderBy("path", "record_offset").collect()
    assert [r.uri for r in rows] == ["http://a", "http://b"] * 2
    assert b"".join(bytes(r.record) for r in rows[:2]) == raw and rows[1].record_offset == rows[0].record_length


def test_warc_reading_goes_on_after_damage(spark, tmp_path):
    record = lambda k, size=5: f"WARC/1.1\r\nWARC-Target-URI: u{k}\r\nContent-Length: {size}\r\n\r\nbody{k}\r\n\r\n".encode()
    parts = [record(0), record(1, 3), record(2, 50), record(3, "x"), record(5), b"XARC/1.1\r\nrot\r\n\r\n", record(4)]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    rows = sorted(warc_fixity.read_warc(spark, str(tmp_path / "a.warc")).collect(), key=lambda r: r.record_offset)
    assert [bytes(r.record) for r in rows] == parts
    assert [(r.uri, r.error is None) for r in rows] == [("u0", True), ("u1", False), ("u2", False), ("u3", False), ("u5", True), (None, False), ("u4", True)]
    members = [gzip.compress(record(k)) for k in range(3)]
    members[1] = members[1][:12] + b"\xff\xff\xff\xff" + members[1][16:]
    (tmp_path / "b.warc.gz").write_bytes(b"".join(members))
    rows = warc_fixity.read_warc(spark, str(tmp_path / "b.warc.gz")).collect()
    assert {r.uri for r in rows if r.error is None} == {"u0", "u2"} and any((r.error or "").startswith("gzip") for r in rows)
