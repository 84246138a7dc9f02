"""Packages read by ranges: the same rows as whole files give, filters in the plan, and bytes counted."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from foliolake.corpus import PackageCorpus
from foliolake.sources import docx, ranged, word, zipraw


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("packages")
    (root / "deep").mkdir()
    for k in range(4):
        parts = {"word/document.xml": f"<w:document><w:body><w:p><w:r><w:t>text {k} old</w:t></w:r></w:p></w:body></w:document>".encode(), "word/header1.xml": b"<w:hdr/>", "word/media/image1.png": os.urandom(200_000)}
        (root / "deep" / f"{k}.docx").write_bytes(docx.write_package(parts))
    (root / "broken.docx").write_bytes(b"no zip")
    (root / "other.txt").write_bytes(b"not read")
    return str(root)


def rows(frame) -> list[tuple]:
    return sorted((tuple(None if c is None else bytes(c) if isinstance(c, bytearray) else c for c in r) for r in frame.collect()), key=repr)


def test_rows_are_those_of_whole_files(spark, folder):
    whole = docx.members(docx.read_packages(spark, folder).filter("path like '%.docx'"))
    columns = ["package_id", "part_path", "part_no", "bytes", "sha256", "content"]
    assert rows(ranged.members(spark, folder).select(*columns)) == rows(whole.select(*columns))
    broken = ranged.members(spark, folder).filter("error is not null").collect()
    assert [r.path.rpartition("/")[2] for r in broken] == ["broken.docx"]


def test_empty_folders(spark, tmp_path):
    assert ranged.members(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(("where", "names"), [("part_path = 'word/document.xml'", 1), ("part_path in ('word/header1.xml', 'word/document.xml')", 2), ("part_path like 'word/%'", 3), ("part_path like '%.xml' and part_path like 'word/h%'", 1), ("length(part_path) > 3 and part_path = 'word/header1.xml'", 1)])
def test_filters_are_pushed_and_hold(spark, folder, where, names):
    found = ranged.members(spark, folder).filter(where)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "part_path" in plan.split("PushedFilters")[-1] and "PushedFilters: []" not in plan
    assert found.count() == 4 * names


def test_only_what_is_asked_for_is_read(folder):
    path = f"{folder}/deep/0.docx"
    raw, read = open(path, "rb").read(), []

    def counted(at: int, size: int) -> bytes:
        read.append(size)
        return raw[at : at + size]

    wanted = ranged.Wanted([("is", ("word/document.xml",))])
    assert [r[0] for r in ranged.wanted_members(counted, len(raw), wanted)] == ["word/document.xml"]
    assert sum(read) < 6000 < 200_000 < len(raw)
    assert [r[0] for r in ranged.wanted_members(counted, len(raw), ranged.Wanted([("is", ("none",))]))] == []


def test_damaged_members_are_errors(folder):
    raw = bytearray(open(f"{folder}/deep/1.docx", "rb").read())
    entry = next(e for e in zipraw.directory(zipraw.of_bytes(bytes(raw)), len(raw)).entries if e.name == "word/media/image1.png")
    raw[entry.at + 5000] ^= 255
    found = {r[0]: r[5] for r in ranged.wanted_members(zipraw.of_bytes(bytes(raw)), len(raw), ranged.Wanted())}
    assert found["word/document.xml"] is None and found["word/media/image1.png"]


def test_packages_are_edited_and_written(spark, folder, tmp_path):
    corpus = PackageCorpus(spark, folder)
    after = corpus.write_packages(corpus.track_replacement("old", "new", "me", "2020"), f"{tmp_path}/out")
    assert after.count() == 6  # other.txt is no package and stays as it is
    members = ranged.members(spark, f"{tmp_path}/out").filter("part_path = 'word/document.xml'").cache()
    assert members.count() == 4 and word.segments(word.items(members)).groupBy("kind").count().orderBy("kind").collect() == [(None, 4), ("delete", 4), ("insert", 4)]
    again = ranged.members(spark, f"{tmp_path}/out").filter("part_path = 'word/media/image1.png'").select("sha256")
    assert rows(again) == rows(corpus.members.filter("part_path = 'word/media/image1.png'").select("sha256"))
    assert rows(corpus.delete_comment("7").select(F.sha2("content", 256))) == rows(corpus.packages.select(F.sha2("content", 256)))
