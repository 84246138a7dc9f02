"""Word packages: tokenizing, trees, paragraph ids, members, images."""

from __future__ import annotations

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliolake.sources import docx, word, xmlscan

BODY = (
    "<w:document><w:body><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t/></w:r><w:ins><w:del><w:r><w:delText>two</w:delText></w:r></w:del></w:ins></w:p>"
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a&amp;b</w:t></w:r></w:p></w:tc><w:tc><w:tbl><w:tr><w:tc><w:p><w:r><w:t>in</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    "<w:p><w:r><w:drawing><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></w:drawing></w:r><w:r><w:t>after</w:t></w:r></w:p>"
    "<w:sdt><w:sdtContent><w:p><w:r><w:t>control</w:t></w:r></w:p></w:sdtContent></w:sdt></w:body></w:document>"
)


def kinds(xml: bytes) -> list[tuple[str, bool, bool]]:
    tags = xmlscan.scan(xml)
    return list(zip(tags.names, tags.closing.tolist(), tags.empty.tolist(), strict=True))


def test_paragraph_ids():
    found = [(pid, leaf, text, revision) for pid, _, leaf, text, revision, opaque in docx.leaves_of(BODY, "document") if not opaque]
    assert found == [
        ("P0", 0, "one", None), ("P0", 1, "", None), ("P0", 2, "two", "delete"), ("T0.R0.C0.P0", 0, "a&b", None), ("T0.R0.C1.T0.R0.C0.P0", 0, "in", None),
        ("T0.R0.C1.P0", 0, "c", None), ("B0.P0", 0, "box", None), ("P1", 1, "after", None), ("S0.P0", 0, "control", None),
    ]
    assert docx.leaves_of("<w:hdr><w:p><w:r><w:t>h</w:t></w:r></w:p></w:hdr>", "header1")[0][0] == "header1.P0"


def test_comments_and_cdata_hide_tags():
    assert kinds(b'<a x=">"><!-- <b> --><![CDATA[<c>]]><?p <d>?><e/></a>') == [("a", False, False), ("e", False, True), ("a", True, False)]


def test_ill_formed_texts_have_an_error():
    faults = {b"<a><b></a>": "unexpected </a>", b"<a>": "<a> isn't closed", b"</a>": "unexpected </a>", b"<a></a></b>": "unexpected </b>"}
    assert {xml: xmlscan.tree(xmlscan.scan(xml)).error for xml in faults} == faults
    whole = xmlscan.tree(xmlscan.scan(b"<a><b/><c></c></a>"))
    assert [x.tolist() for x in (whole.tag, whole.parent, whole.depth, whole.close)] == [[0, 1, 2], [-1, 0, 0], [0, 1, 1], [4, 1, 3]] and whole.error is None


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.just(""), lambda inner: st.lists(st.tuples(st.sampled_from(["w:p", "tbl", "x"]), inner), max_size=3).map(lambda xs: "".join(f"<{n}>{i}</{n}>" for n, i in xs)), max_leaves=12))
def test_nested_texts_are_balanced_whatever_comments_stand_between(xml):
    tags = xmlscan.scan(xml.encode())
    found = xmlscan.tree(tags)
    assert found.error is None and len(found.tag) == xml.count("</")
    assert all(tags.names[a] == tags.names[b] for a, b in zip(found.tag, found.close, strict=True))
    assert xmlscan.scan(xml.replace("</", "<!-- </q> --></").encode()).names == tags.names


PIECES = ["<w:p>", "</w:p>", '<w:r a="1">', "</w:r>", "<x/>", '<a b=">"/>', "<a b='<'>", "</a>", "text ", '"', "'", "<!-- </w:p> -->", "<![CDATA[<q>]]>", "<?pi <z>?>", "<!DOCTYPE x>", """<a b="</c>" d='"'>""", "< ", ">", "<!--", "<a ", "é"]


def slow_scan(xml: str) -> list[tuple]:
    """Tags by one pattern, from place to place, without a care for time."""
    pattern = re.compile(r"""<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!(?!--|\[CDATA\[)[^>]*>|<(/?)([^\s/>!?<"'=][^\s/><]*)((?:[^>"'<]|"[^"]*"|'[^']*')*?)(/?)>""", re.S)
    place = lambda k: len(xml[:k].encode())
    return [(m[2].rpartition(":")[2], place(m.start()), place(m.end()), bool(m[1]), bool(m[4])) for m in pattern.finditer(xml) if m[2]]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_scanning_equals_a_slow_scan_on_any_text(xml):
    tags = xmlscan.scan(xml.encode())
    assert list(zip(tags.names, tags.start.tolist(), tags.end.tolist(), tags.closing.tolist(), tags.empty.tolist(), strict=True)) == slow_scan(xml)
    xmlscan.tree(tags)
    docx.items_of(xml, "document")


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_any_bytes_can_be_scanned(raw):
    tags = xmlscan.scan(raw)
    assert all(0 <= a < b <= len(raw) for a, b in zip(tags.start, tags.end, strict=True))


HOSTILE = ["<a " * 100_000, '<a b="' * 70_000, "<a b='x\">" * 40_000, "<!--" * 100_000, "<w:r><w:rPr>" * 30_000, "<n>" * 100_000 + "</n>" * 100_000, "<![CDATA[" * 45_000, "<?" * 200_000, "<a<" * 130_000 + ">", "<w:p>" + '<w:ins w:id="1">' * 8000, "<w:hyperlink>" * 30_000 + "<w:p><w:t>x</w:t>"]


@pytest.mark.parametrize("xml", HOSTILE, ids=[x[:12] for x in HOSTILE])
def test_hostile_parts_take_time_in_proportion(xml):
    began = time.process_time()
    tags = xmlscan.scan(xml.encode())
    xmlscan.tree(tags)
    docx.items_of(xml, "document")
    assert time.process_time() - began < 8


def test_members_images_and_errors(spark):
    package = docx.build_package(["a < b", "", "c"], "head", b"\x89PNG")
    rows = spark.createDataFrame([(1, bytearray(package)), (2, bytearray(b"no zip")), (3, None)], "package_id long, content binary")
    members = docx.members(rows).cache()
    assert {r.package_id: bool(r.error) for r in members.collect()} == {1: False, 2: True, 3: True}
    leaves = docx.prose_leaves(members.filter("error is null")).orderBy("part", "paragraph_order").collect()
    assert [(r.paragraph_id, r.text) for r in leaves] == [("P0", "a < b"), ("P1", ""), ("P2", "c"), ("header1.P0", "head")]
    assert [r.base64 for r in docx.images(members.filter("error is null")).collect()] == ["iVBORw=="]
    names = [r.name for r in docx.xml_tags(members.filter("part_path = 'word/header1.xml'")).orderBy("idx").collect()]
    assert names == ["hdr", "p", "r", "t", "t", "r", "p", "hdr"]


def test_patching_keeps_the_other_members():
    package = docx.build_package(["x"], "h", b"i")
    assert docx.patch_package(package, {}) == package
    import io
    import zipfile

    patched = zipfile.ZipFile(io.BytesIO(docx.patch_package(package, {"word/header1.xml": b"<new/>"})))
    assert patched.read("word/header1.xml") == b"<new/>" and b"<w:t" in patched.read("word/document.xml")


def test_folders_are_read(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.docx").write_bytes(docx.build_package(["x"]))
    assert docx.members(docx.read_packages(spark, str(tmp_path))).count() == 4


def test_links_of_real_packages(spark):
    kinds = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
    rel = lambda k, kind, target, more="": f"<Relationship Id='rId{k}' Type=\"{kinds}{kind}\" Target=\"{target}\"{more}/>"
    rels = lambda *links: f"<Relationships>{''.join(links)}<!-- {rel(9, 'image', 'gone.png')} --></Relationships>".encode()
    parts = {
        "_rels/.rels": rels(rel(1, "officeDocument", "word/document.xml"), rel(2, "core-properties", "/docProps/core.xml")),
        "word/document.xml": b"<w:document/>", "word/media/a.png": b"png", "docProps/core.xml": b"<x/>", "customXml/item1.xml": b"<x/>", "word/header1.xml": b"<w:hdr/>",
        "word/_rels/document.xml.rels": rels(rel(1, "image", "media/a.png"), rel(2, "hyperlink", "https://example.org/?a=1&amp;b=2", ' TargetMode="External"'), rel(3, "customXml", "../customXml/item1.xml"), rel(4, "header", "header1.xml"), rel(5, "hyperlink", "#mark")),
    }
    broken = parts | {"word/_rels/header1.xml.rels": rels(rel(1, "image", "media/none.png"), rel(2, "back", "document.xml"))}
    rows = spark.createDataFrame([(1, bytearray(docx.write_package(parts))), (2, bytearray(docx.write_package(broken)))], "package_id long, content binary")
    members = docx.members(rows).cache()
    assert [tuple(r) for r in docx.broken_links(members).collect()] == [(2, 1, 1)]
    found = {(r.source_path, r.rel_id): (r.type, r.target, r.external, r.target_path) for r in docx.relationships(members).filter("package_id = 1").collect()}
    assert found["", "rId2"] == ("core-properties", "/docProps/core.xml", False, "docProps/core.xml") and found["word/document.xml", "rId3"][3] == "customXml/item1.xml"
    assert found["word/document.xml", "rId2"][1:] == ("https://example.org/?a=1&b=2", True, None) and len(found) == 7
    assert [(r.rel_id, r.part_path) for r in docx.images(members).filter("package_id = 1").collect()] == [("rId1", "word/media/a.png")]


def test_parts_are_numbered_by_order_without_a_cap(spark):
    part = lambda t: f"<x><w:p><w:r><w:t>{t}</w:t></w:r></w:p></x>".encode()
    names = ["word/footer1.xml", *(f"word/header{k}.xml" for k in (1001, 2, 999, 1000)), "word/footnotes.xml", "word/document.xml", "word/header12345678901234567890.xml", "word/header.xml"]
    members = docx.members(spark.createDataFrame([(1, bytearray(docx.write_package({n: part(n) for n in names})))], "package_id long, content binary"))
    rows = word.paragraphs(word.items(members)).orderBy("idx").collect()
    assert [r.text[5:-4] for r in rows] == ["document", "header", "header2", "header999", "header1000", "header1001", "header12345678901234567890", "footer1", "footnotes"]
    assert len({r.idx for r in rows}) == len(names)
