"""Edits written into packages: the archive, the algebra of splices, and each edit read back."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from test_packages import REVISED, package

from foliolake.operators import splices
from foliolake.sources import docx, word, zipraw


def frame(spark, *contents):
    return spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in enumerate(contents)], "package_id long, content binary").cache()


def spans(packages):
    return docx.spans(docx.members(packages).filter("error is null"), splices.WANTED).cache()


def written(packages, edits):
    return splices.applied(packages, edits).cache()


def read(packages) -> list[dict[str, bytes]]:
    out = []
    for r in packages.orderBy("package_id").collect():
        with zipfile.ZipFile(io.BytesIO(bytes(r.content))) as archive:
            assert archive.testzip() is None
            out.append({n: archive.read(n) for n in archive.namelist()})
    return out


def odd_archive() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.comment = b"a comment"
        for name, method, body in (("a.xml", zipfile.ZIP_DEFLATED, b"<a/>" * 500), ("stored.bin", zipfile.ZIP_STORED, bytes(range(256))), ("ü.xml", zipfile.ZIP_DEFLATED, b"x"), ("empty", zipfile.ZIP_STORED, b"")):
            info = zipfile.ZipInfo(name, (2001, 2, 3, 4, 5, 6))
            info.compress_type, info.external_attr, info.comment, info.extra = method, 0o640 << 16, b"about " + name.encode(), b"\x99\x99\x02\x00hi"
            archive.writestr(info, body)
        with archive.open("streamed.xml", "w") as member:  # sizes come after the data
            member.write(b"y" * 3000)
    return out.getvalue()


@pytest.mark.parametrize("changed", [{}, {"a.xml": b"<b/>"}, {"stored.bin": b"", "streamed.xml": b"z" * 9}, {"ü.xml": b"long" * 999}, {"none": b"x"}])
def test_members_that_stay_keep_every_byte(changed):
    content = odd_archive()
    after = zipraw.rewritten(content, changed)
    before, now = zipraw.stored_bytes(content), zipraw.stored_bytes(after)
    assert list(before) == list(now) and all(before[n] == now[n] for n in before if n not in changed)
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(io.BytesIO(after)) as new:
        assert new.testzip() is None and new.comment == old.comment
        assert {n: new.read(n) for n in new.namelist()} == {n: changed.get(n, old.read(n)) for n in old.namelist()}
        same = lambda a: [(i.filename, i.date_time, i.external_attr, i.comment, i.extra, i.compress_type) for i in a.infolist()]
        assert same(old) == same(new)
    if not set(changed) & set(before):
        assert after == content


@pytest.mark.parametrize("content", [b"", b"no zip", odd_archive()[:-30], odd_archive()[:200]])
def test_broken_archives_are_errors(content):
    with pytest.raises(ValueError):
        zipraw.directory(zipraw.of_bytes(content), len(content))


def test_disjoint_splices_equal_edits_one_by_one(spark):
    """Deletions less kept ranges and replacements, against bytes marked one by one."""
    rng, rows, kept, expected = random.Random(5), [], [], {}
    raw = "abcdefghijklmnopqrstuvwxyz" * 4
    for k in range(60):
        alive, new = [True] * len(raw), {}
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(0, 99)
            b = rng.randint(a, 104)
            rows.append((k, "x.xml", a, b, []))
            alive[a:b] = [False] * (b - a)
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 99)
            kept.append((k, "x.xml", a, a + 3))
            alive[a : a + 3] = [True] * 3
        expected[k] = "".join(c for c, there in zip(raw, alive, strict=True) if there)
        assert not new
    schema = f"package_id long, part_path string, start long, end long, pieces {splices.PIECES}"
    # kept ranges are those of whole elements: none is cut by the border of what goes
    ranges = [r[:4] for r in rows]
    kept = [x for x in kept if all(not (r[0] == x[0] and (r[2] < x[3] and x[2] < r[3]) and not (r[2] <= x[2] and x[3] <= r[3])) for r in ranges) and all(y is x or y[0] != x[0] or y[3] <= x[2] or x[3] <= y[2] for y in kept)]
    for k in expected:
        alive = [not any(r[0] == k and r[2] <= i < r[3] for r in ranges) or any(x[0] == k and x[2] <= i < x[3] for x in kept) for i in range(len(raw))]
        expected[k] = "".join(c for c, there in zip(raw, alive, strict=True) if there)
    good, clash = splices.disjoint(spark.createDataFrame(rows, schema), spark.createDataFrame(kept, "package_id long, part_path string, start long, end long"))
    assert clash.isEmpty()
    contents = frame(spark, *[docx.write_package({"x.xml": raw.encode()}) for _ in expected])
    assert [p["x.xml"].decode() for p in read(written(contents, good))] == [expected[k] for k in sorted(expected)]


def test_conflicts_stop_their_package_only(spark):
    piece = lambda t: [(t, None, None)]
    rows = [
        (0, "x.xml", 2, 5, piece("A")), (0, "x.xml", 4, 8, piece("B")),  # overlap
        (1, "x.xml", 2, 6, []), (1, "x.xml", 3, 4, piece("C")),  # inside what goes
        (2, "x.xml", 2, 6, []), (2, "x.xml", 2, 2, piece("D")), (2, "x.xml", 6, 6, piece("F")), (2, "x.xml", 6, 6, piece("E")), (2, "x.xml", 4, 8, []), (2, "x.xml", 8, 9, piece("G")), (2, "x.xml", 8, 9, piece("G")),
        (3, "x.xml", 0, 1, piece("H")), (3, "x.xml", 0, 1, piece("I")), (3, "y.xml", 0, 1, []),
    ]
    rows = [r for r in rows if r[:4] != (2, "x.xml", 6, 6)]
    good, clash = splices.disjoint(spark.createDataFrame(rows, f"package_id long, part_path string, start long, end long, pieces {splices.PIECES}"))
    assert {r.package_id: r.reason for r in clash.collect()} == {0: "replaces-what-is-edited", 1: "replaces-what-is-edited", 3: "replaces-what-is-edited"}
    contents = frame(spark, *[docx.write_package({"x.xml": b"0123456789", "y.xml": b"y"})] * 4)
    assert [p["x.xml"] for p in read(written(contents, good))] == [b"0123456789", b"0123456789", b"01DG9", b"0123456789"]


def text_items(packages) -> list[tuple]:
    rows = word.items(docx.members(packages)).orderBy("package_id", "idx", "position").collect()
    return [(r.package_id, r.part, r.paragraph_id, r.item, r.text, r.style, r.ref) for r in rows]


@pytest.mark.parametrize("accept", [True, False])
def test_settled_packages_read_as_settled_items(spark, accept):
    header = '<w:hdr><w:p><w:ins w:id="1"><w:r><w:t>h</w:t></w:r></w:ins><w:r><w:t>k</w:t></w:r></w:p></w:hdr>'
    nested = '<x:document xmlns:x="w"><x:body><x:p><x:ins x:id="1"><x:r><x:t>a</x:t></x:r><x:del x:id="2"><x:r><x:rPr><x:b/></x:rPr><x:delText xml:space="preserve">b &amp; c </x:delText></x:r><x:r><x:commentReference x:id="5"/></x:r></x:del></x:ins><x:del x:id="3"/></x:p><x:p><x:del x:id="4"><x:r><x:delText/></x:r><x:bookmarkStart x:id="8"/></x:del><x:moveTo x:id="6"><x:r><x:t>m</x:t></x:r></x:moveTo></x:p></x:body></x:document>'
    packages = frame(spark, package(REVISED, **{"word/header1.xml": header, "word/media/i.png": "png"}), package(nested), docx.document_package([f"line {k} of some text" for k in range(13)], "A & B"))
    settled = word.settle(word.items(docx.members(packages)), accept).orderBy("package_id", "idx", "position").collect()
    good, clash = splices.disjoint(*splices.settle(spans(packages), accept))
    assert clash.isEmpty()
    after = written(packages, good)
    assert text_items(after) == [(r.package_id, r.part, r.paragraph_id, r.item, r.text, r.style, r.ref) for r in settled]
    members = docx.members(after)
    assert docx.elements(members).filter("error is not null").isEmpty()
    assert not any(tag in part for p in read(after) for part in p.values() for tag in (b"<w:ins", b"<w:del", b"<x:del", b"<x:ins", b"delText", b"moveTo"))
    edited = {"word/document.xml", "word/header1.xml"}
    for old, new in zip(packages.orderBy("package_id").collect(), after.orderBy("package_id").collect(), strict=True):
        a, b = zipraw.stored_bytes(bytes(old.content)), zipraw.stored_bytes(bytes(new.content))
        assert all(a[n] == b[n] for n in a if n not in edited)
    again = splices.disjoint(*splices.settle(spans(after), not accept))[0]
    assert again.isEmpty()


def test_deleted_comments_leave_no_trace(spark):
    packages = frame(spark, docx.document_package([f"line {k} of text" for k in range(20)], "a"), b"no zip")
    ids = spark.createDataFrame([(0, "5"), (0, "17"), (0, "99")], "package_id long, id string")
    good, clash = splices.disjoint(splices.delete_comments(spans(packages), ids))
    assert clash.isEmpty()
    after = written(packages, good)
    members = docx.members(after).filter("error is null").cache()
    assert [r.id for r in docx.comment_entries(members).orderBy("id").collect()] == ["11"]
    assert [r.para_id for r in docx.extended_entries(members).collect()] == ["0000000B"]
    anchors = word.comment_anchors(word.items(members)).collect()
    assert [(r.id, r.kind) for r in sorted(anchors, key=lambda r: r.ordinal)] == [("11", "comment-start"), ("11", "comment-end"), ("11", "comment-reference")]
    document = read(after.filter("package_id = 0"))[0]["word/document.xml"]
    assert b"<w:r></w:r>" not in document and document.count(b"commentReference") == 1
    assert [bytes(r.content) for r in after.filter("package_id = 1").collect()] == [b"no zip"]


TABLES = (
    '<w:document><w:body><w:tbl><w:tblPr/><w:tr w:id="r"><w:trPr><w:h/></w:trPr><w:tc><w:tcPr><w:tcW w:w="5"/></w:tcPr><w:p w:x="1"><w:pPr><w:jc/></w:pPr><w:r><w:t>a</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc>'
    '<w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t></w:t></w:r></w:p></w:tc><w:tc><w:tcPr/><w:p><w:r><w:t>last</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    "<w:tbl><w:tr><w:tc><w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl><w:p/></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>"
)


def document_after(spark, xml, edits) -> str:
    packages = frame(spark, package(xml))
    good, clash = splices.disjoint(edits(spans(packages)))
    assert clash.isEmpty()
    return read(written(packages, good))[0]["word/document.xml"].decode()


def test_rows_are_inserted(spark):
    targets = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (0, 1, 7)], "package_id long, table_index int, row_index int")
    new = '<w:tr w:id="r"><w:trPr><w:h/></w:trPr><w:tc><w:tcPr><w:tcW w:w="5"/></w:tcPr><w:p w:x="1"><w:pPr><w:jc/></w:pPr></w:p></w:tc><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p/></w:tc><w:tc><w:p></w:p></w:tc><w:tc><w:tcPr/><w:p></w:p></w:tc></w:tr>'
    first, second, third = TABLES.split("</w:tr></w:tbl>")[0], TABLES.split("<w:tbl>")[2], "<w:tr><w:tc><w:p/></w:tc><w:tc><w:p/></w:tc></w:tr>"
    found = document_after(spark, TABLES, lambda s: splices.insert_rows(s, targets))
    assert found == TABLES.replace("last</w:t></w:r></w:p></w:tc></w:tr>", "last</w:t></w:r></w:p></w:tc></w:tr>" + new).replace("<w:tc><w:p/></w:tc></w:tr></w:tbl></w:body>", "<w:tc><w:p/></w:tc></w:tr>" + third + "</w:tbl></w:body>")
    assert first and second


@pytest.mark.parametrize(
    ("first", "count", "discard", "code", "old", "new"),
    [
        (0, 3, False, None, '<w:tcW w:w="5"/></w:tcPr>', '<w:tcW w:w="5"/><w:gridSpan w:val="4"/></w:tcPr>'),
        (1, 2, False, None, '<w:gridSpan w:val="2"/>', '<w:gridSpan w:val="3"/>'),
        (2, 2, True, None, "<w:tc><w:p><w:r><w:t></w:t>", '<w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t></w:t>'),
        (2, 2, False, "merge-would-discard-content", "", ""),
        (3, 2, True, "span-out-of-range", "", ""),
    ],
)
def test_cells_are_merged(spark, first, count, discard, code, old, new):
    targets = spark.createDataFrame([(0, 0, 0, first, count, discard)], "package_id long, table_index int, row_index int, first int, count int, discard boolean")
    found = document_after(spark, TABLES, lambda s: splices.merge_cells(s, targets)[0])
    refused = [r.code for r in splices.merge_cells(spans(frame(spark, package(TABLES))), targets)[1].collect()]
    assert refused == ([code] if code else [])
    if code:
        assert found == TABLES
    else:
        cells = word.cells(word.paragraphs(word.items(docx.members(frame(spark, package(found))))))
        assert old not in found.split("</w:tbl>")[0] and new in found and found.count("<w:tc>") == TABLES.count("<w:tc>") - count + 1
        assert docx.elements(docx.members(frame(spark, package(found)))).filter("error is not null").isEmpty() and cells.count() > 0


def test_replacements_are_tracked(spark):
    xml = (
        '<w:document><w:body><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>one old &lt;two&gt;</w:t></w:r><w:ins w:id="7"><w:r><w:t>new old text</w:t></w:r></w:ins><w:del w:id="3"><w:r><w:t>old</w:t></w:r></w:del></w:p>'
        "<w:p><w:r><w:t>old and old</w:t></w:r><w:r><w:t>old</w:t><w:br/><w:t>x</w:t></w:r><w:r><w:t>old</w:t></w:r></w:p></w:body></w:document>"
    )
    packages = frame(spark, package(xml))
    edits, refused = splices.track_replacements(spans(packages), "old", "<new>", "Me", "2020")
    assert sorted(r.code for r in refused.collect()) == ["ambiguous", "complex-run", "in-deletion"]
    found = read(written(packages, splices.disjoint(edits)[0]))[0]["word/document.xml"].decode()
    by = lambda k: f'w:id="{k}" w:author="Me" w:date="2020"'
    text = lambda t, rpr="", tag="t": f'<w:r>{rpr}<w:{tag} xml:space="preserve">{t}</w:{tag}></w:r>'
    bold = "<w:rPr><w:b/></w:rPr>"
    change = lambda k, rpr="": f"<w:del {by(k)}>{text('old', rpr, 'delText')}</w:del><w:ins {by(k + 1)}>{text('&lt;new&gt;', rpr)}</w:ins>"
    expected = xml.replace('<w:r><w:rPr><w:b/></w:rPr><w:t>one old &lt;two&gt;</w:t></w:r>', text("one ", bold) + change(8, bold) + text(" &lt;two&gt;", bold))
    expected = expected.replace("<w:t>new old text</w:t>", '<w:t xml:space="preserve">new &lt;new&gt; text</w:t>').replace("<w:r><w:t>old</w:t></w:r></w:p></w:body>", change(10) + "</w:p></w:body>")
    assert found == expected
    views = {accept: [t[4] for t in text_items(written(frame(spark, package(found)), splices.disjoint(*splices.settle(spans(frame(spark, package(found))), accept))[0]))] for accept in (True, False)}
    assert "".join(views[True]) == "one <new> <two>new <new> textold and oldoldx<new>" and "".join(views[False]) == "one old <two>oldold and oldoldxold"


def test_no_packages_and_no_edits(spark):
    none = frame(spark, package(REVISED)).filter("package_id > 5")
    good, clash = splices.disjoint(*splices.settle(spans(none), True))
    assert clash.isEmpty() and splices.applied(none, good).count() == 0
    packages = frame(spark, b"no zip", None, package("<w:document><w:p>"))
    good, _ = splices.disjoint(*splices.settle(spans(packages), True))
    assert [r.content and bytes(r.content) for r in splices.applied(packages, good).orderBy("package_id").collect()] == [b"no zip", None, package("<w:document><w:p>")]
    assert packages.filter(F.col("content").isNull()).count() == 1
