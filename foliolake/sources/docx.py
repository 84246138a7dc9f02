"""Word packages as rows: members, tags, element trees, items of paragraphs, images.

Packages are read with ``binaryFile`` (or come as a binary column). One function
unzips a package into its members; another turns a member's XML into tags, or
into items: text runs, opaque blocks, anchors and paragraph marks, in order, each
with its paragraph, style and the revisions around it. Everything after that is
DataFrame work (``foliolake.sources.word``). A package or member that can't be
read gives a row with an error.
"""

from __future__ import annotations

import functools
import hashlib
import io
import re
import zipfile
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr, unescape

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.functions.batches import map_columns, map_records
from foliolake.functions.text import resolve_target, xml_unescape
from foliolake.sources.xmlscan import Tags, scan, tree
from foliolake.sources.zipraw import rewritten, stored_bytes

PACKAGES = "package_id long, content binary"
MEMBERS = "package_id long, part_path string, part_no long, bytes long, sha256 string, content binary, error string"
TAGS = "package_id long, part_path string, idx long, name string, start long, end long, closing boolean, self_closing boolean"
ELEMENTS = "package_id long, part_path string, idx long, parent_idx long, depth long, name string, error string"
LEAVES = "package_id long, part string, paragraph_id string, paragraph_order long, leaf long, text string, revision string, opaque boolean"
REVISION = "struct<kind:string,w_id:string,author:string,date:string>"
ITEMS = f"package_id long, part string, part_no long, paragraph_id string, paragraph_order long, position long, item string, text string, style string, ref string, revisions array<{REVISION}>"
COMMENTS = "package_id long, id string, author string, date string, text string, para_id string"
SPANS = "package_id long, part_path string, idx long, parent_idx long, depth long, name string, prefix string, start long, inner long, inner_end long, end long, ref string, text string, parent_name string, parent_start long, parent_end long"
STORED = "package_id long, part_path string, stored_sha256 string"
STATS = "package_id long, package_bytes long, zip_parts long, duplicate_entries long, total_bytes long, uncompressed_xml_bytes long, max_part_bytes long, max_text_node_bytes long, xml_nesting_depth long, valid boolean"

_REVISIONS = {"ins": "insert", "del": "delete", "moveFrom": "move_from", "moveTo": "move_to"}
_OPAQUE = frozenset("drawing pict object fldSimple oMath sym".split())
_PROSE_PART = re.compile(r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml")
_ANCHORS = {"commentRangeStart": "comment-start", "commentRangeEnd": "comment-end", "commentReference": "comment-reference", "bookmarkStart": "bookmark-start", "bookmarkEnd": "bookmark-end"}
_ATTRIBUTE = re.compile(r"""([^\s=/]+)\s*=\s*("[^"]*"|'[^']*')""")
_NAMED = {"&quot;": '"', "&apos;": "'"}


@dataclass
class _Scope:
    """A place that numbers what is inside it."""

    prefix: str
    paragraphs: int = 0
    tables: int = 0
    rows: int = -1
    cells: int = -1


@dataclass
class _Open:
    name: str
    scope: _Scope | None = None
    paragraph: tuple[str, int] | None = None
    around: tuple[tuple[str, str, str, str], ...] = ()
    link: str | None = None
    style: str = ""


@dataclass
class Item:
    """What stands in a paragraph: text, opaque, mark, or an anchor (by its name in ``_ANCHORS``)."""

    paragraph_id: str | None
    paragraph_order: int | None
    item: str
    text: str = ""
    style: str = ""
    ref: str | None = None
    revisions: tuple[tuple[str, str, str, str], ...] = ()


def attributes_of(raw: str) -> dict[str, str]:
    """Attributes of a tag by local name."""
    return {m[1].rpartition(":")[2]: unescape(m[2][1:-1], _NAMED) for m in _ATTRIBUTE.finditer(raw)}


def canonical_properties(tags: Tags, first: int, last: int) -> str:
    """The spelling of a run's properties (tags ``first`` to ``last``) that doesn't depend on prefixes, attribute order or recorded changes."""
    out, skipped = [], 0
    for k in range(first, last):
        name, closing, empty = tags.names[k], tags.closing[k], tags.empty[k]
        if name == "rPrChange":
            skipped += 0 if empty else -1 if closing else 1
        elif not skipped:
            attributes = "".join(f" {a}={v}" for a, v in sorted(attributes_of(tags.attributes(k)).items()))
            out.append(f"/{name}" if closing else f"{name}{attributes}" + "/" * bool(empty))
    return ";".join(out)


def _revision(name: str, attributes: str) -> tuple[str, str, str, str]:
    at = attributes_of(attributes)
    return _REVISIONS[name], at.get("id", ""), at.get("author", ""), at.get("date", "")


def _bytes(xml: str | bytes) -> bytes:
    return xml.encode() if isinstance(xml, str) else xml


def items_of(xml: str | bytes, part: str) -> list[Item]:
    """The items of a part's paragraphs, in order.

    Ids: ``P0`` in the body, ``T0.R1.C2.P0`` in a cell, ``B0.P0`` in a text box,
    ``S0.P0`` in a content control; other parts put their name before. Revisions
    are those around the item, outermost first. An anchor between paragraphs has
    no paragraph. Time is in proportion to the tags; what is around a place is
    kept while its tags are passed, and never gathered anew.
    """
    base = "" if part == "document" else f"{part}."
    scope, boxes, controls = _Scope(base), 0, 0
    stack: list[_Open] = []
    opened: dict[str, int] = {}
    out: list[Item] = []
    order, style = -1, ""
    paragraph: tuple[str, int] | None = None
    around: tuple[tuple[str, str, str, str], ...] = ()
    link: str | None = None
    tags = scan(_bytes(xml))
    starts, ends, closings, empties = tags.start.tolist(), tags.end.tolist(), tags.closing.tolist(), tags.empty.tolist()
    # a run's properties end where the next rPr does, or at the next run
    stops = [k for k, name in enumerate(tags.names) if name == "r" or (name == "rPr" and closings[k])]
    for k, name in enumerate(tags.names):
        if closings[k]:
            while opened.get(name):
                last = stack.pop()
                opened[last.name] -= 1
                scope, paragraph, around, link = last.scope or scope, last.paragraph, last.around, last.link
                style = last.style if last.name in ("r", "txbxContent") else style
                if last.name == name:
                    break
            continue
        empty = empties[k]
        here = _Open(name, scope, paragraph, around, link, style)
        place = paragraph or (None, None)
        if name == "p":
            order += 1
            paragraph = (f"{scope.prefix}P{scope.paragraphs}", order)
            scope.paragraphs += 1
        elif name == "tbl":
            scope.tables += 1
            scope = _Scope(f"{scope.prefix}T{scope.tables - 1}.")
        elif name == "tr":
            scope.rows, scope.cells = scope.rows + 1, -1
        elif name == "tc":
            scope.cells += 1
            scope = _Scope(f"{scope.prefix}R{scope.rows}.C{scope.cells}.")
        elif name == "txbxContent":
            scope, boxes = _Scope(f"{base}B{boxes}."), boxes + 1
        elif name == "sdtContent" and paragraph is None:
            scope, controls = _Scope(f"{base}S{controls}."), controls + 1
        elif name == "r":
            style = ""
        elif name == "rPr" and stack and stack[-1].name == "r" and not empty:
            behind = bisect_right(stops, k)
            style = canonical_properties(tags, k + 1, stops[behind] if behind < len(stops) else len(tags))
        elif name == "hyperlink" and not empty:
            link = attributes_of(tags.attributes(k)).get("id") or link
        elif name in _REVISIONS:
            revision = _revision(name, tags.attributes(k))
            if not empty:
                around = (*around, revision)
            elif len(stack) > 1 and stack[-1].name == "rPr" and stack[-2].name == "pPr":
                out.append(Item(*place, "mark", revisions=(revision,)))
        elif name in _ANCHORS:
            out.append(Item(*place, _ANCHORS[name], ref=attributes_of(tags.attributes(k)).get("id"), revisions=around))
        elif paragraph and (name in ("t", "delText") or name in _OPAQUE):
            opaque = name in _OPAQUE
            end = starts[k + 1] if not opaque and not empty and k + 1 < len(tags) else ends[k]
            text = "" if opaque or empty else unescape(tags.text(ends[k], end), _NAMED)
            out.append(Item(*place, "opaque" if opaque else "text", text, style, link, around))
        if not empty:
            stack.append(here)
            opened[name] = opened.get(name, 0) + 1
        else:
            scope, paragraph = here.scope, here.paragraph
    return out


def leaves_of(xml: str | bytes, part: str) -> list[tuple[str, int, int, str, str | None, bool]]:
    """(paragraph_id, paragraph_order, leaf, text, innermost revision, opaque) of each text run and opaque block."""
    out: list[tuple[str, int, int, str, str | None, bool]] = []
    counts: dict[str, int] = {}
    for i in items_of(xml, part):
        if i.item in ("text", "opaque"):
            leaf = counts.get(i.paragraph_id, 0)
            counts[i.paragraph_id] = leaf + 1
            out.append((i.paragraph_id, i.paragraph_order, leaf, i.text, i.revisions[-1][0] if i.revisions else None, i.item == "opaque"))
    return out


def comments_of(xml: str | bytes) -> list[tuple[str, str, str, str, str | None]]:
    """(id, author, date, text, para_id of the last paragraph) of each entry of a comments part."""
    out: list[list] = []
    tags = scan(_bytes(xml))
    for k, name in enumerate(tags.names):
        if tags.closing[k]:
            continue
        at = attributes_of(tags.attributes(k)) if name in ("comment", "p") else {}
        if name == "comment":
            out.append([at.get("id", ""), at.get("author", ""), at.get("date", ""), [], None])
        elif name == "p" and out:
            out[-1][4] = at.get("paraId", out[-1][4])
        elif name == "t" and out and not tags.empty[k] and k + 1 < len(tags):
            out[-1][3].append(unescape(tags.text(tags.end[k], tags.start[k + 1]), _NAMED))
    return [(*c[:3], "".join(c[3]), c[4]) for c in out]


def stats_of(content: bytes) -> tuple[int, int, int, int, int, int, int, int, bool]:
    """package_bytes, zip_parts, duplicate_entries, total_bytes, uncompressed_xml_bytes, max_part_bytes, max_text_node_bytes, xml_nesting_depth, valid.

    Sizes are those of the archive's directory; only the main part is unpacked.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            entries = archive.infolist()
            names = [e.filename for e in entries]
            xml = archive.read("word/document.xml") if "word/document.xml" in names else b""
    except (zipfile.BadZipFile, ValueError, EOFError):
        return len(content), 0, 0, 0, 0, 0, 0, 0, False
    tags = scan(xml)
    texts = (int(tags.start[k + 1] - tags.end[k]) for k, name in enumerate(tags.names[:-1]) if name == "t" and not tags.closing[k] and not tags.empty[k])
    depths = tree(tags).depth
    xml_bytes = sum(e.file_size for e in entries if e.filename.startswith("word/") and e.filename.endswith(".xml"))
    longest, deepest = max(texts, default=0), int(depths.max()) + 1 if len(depths) else 0
    return len(content), len(names), len(names) - len(set(names)), sum(e.file_size for e in entries), xml_bytes, max((e.file_size for e in entries), default=0), longest, deepest, True


_PART_KINDS = ("document", "header", "footer", "endnotes", "footnotes")


def part_numbers(names: list[str]) -> dict[str, int]:
    """The places of a package's prose parts in the order of extraction: document, headers, footers and notes, each by number."""
    prose = {n: m[1] for n in names if (m := _PROSE_PART.fullmatch(n))}
    number = lambda part: int(re.search(r"\d*$", part)[0] or 0)
    order = sorted(prose, key=lambda n: (_PART_KINDS.index(prose[n].rstrip("0123456789")), number(prose[n]), n))
    return {name: k for k, name in enumerate(order)}


_BROKEN = (zipfile.BadZipFile, ValueError, EOFError)


def _unzipped(content: bytes | None, end: str = "") -> Iterator[tuple[str, bytes, int | None]]:
    """The members whose names end so: name, bytes, and place among the prose parts."""
    with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
        names = archive.namelist()
        numbers = part_numbers(names)
        yield from ((name, archive.read(name), numbers.get(name)) for name in names if name.endswith(end))


def members_of(package_id: int | None, content: bytes | None) -> Iterator[tuple]:
    """A package's rows of MEMBERS; the last has an error if the package can't be read to its end."""
    try:
        for name, raw, number in _unzipped(content):
            yield package_id, name, number, len(raw), hashlib.sha256(raw).hexdigest(), raw, None
    except _BROKEN as broken:
        yield package_id, None, None, None, None, None, str(broken)


def members(packages: DataFrame) -> DataFrame:
    """The members of packages (package_id, content)."""
    return map_records(packages.select("package_id", "content"), lambda record: members_of(record.package_id, record.content), MEMBERS)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder tree as packages, numbered by a hash of their path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("package_id"), "path", "length", "content")


def xml_tags(members: DataFrame) -> DataFrame:
    """The tags of every XML member, in order, with their places in bytes."""

    def read(record):
        found = scan(record.content)
        columns = (found.names, found.start.tolist(), found.end.tolist(), found.closing.tolist(), found.empty.tolist())
        yield from ((record.package_id, record.part_path, k, *tag) for k, tag in enumerate(zip(*columns, strict=True)))

    wanted = members.filter(F.col("part_path").endswith(".xml"))
    return map_records(wanted.select("package_id", "part_path", "content"), read, TAGS)


def elements(members: DataFrame) -> DataFrame:
    def read(record):
        tags = scan(record.content)
        found = tree(tags)
        for k, parent, depth in zip(found.tag.tolist(), found.parent.tolist(), found.depth.tolist(), strict=True):
            yield record.package_id, record.part_path, k, parent if parent >= 0 else None, depth, tags.names[k], None
        if found.error:
            yield record.package_id, record.part_path, None, None, None, None, found.error

    wanted = members.filter(F.col("part_path").endswith(".xml"))
    return map_records(wanted.select("package_id", "part_path", "content"), read, ELEMENTS)


def spans(members: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Elements of some names in every XML member, with their places in bytes.

    ``start`` to ``inner`` is the start tag, ``inner_end`` to ``end`` the end tag; an
    empty element has only the first. ``ref`` is what it is known by: id, paraId
    or val. ``parent_start`` to ``parent_end`` is the whole element around it. Parts
    that are ill-formed have no spans.
    """
    wanted = frozenset(names)
    xml = members.filter(F.col("part_path").endswith(".xml"))
    return map_columns(xml.select("package_id", "part_path", "content"), lambda record: _part_spans(record.package_id, record.part_path, record.content, wanted), SPANS)


def package_spans(packages: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The spans of packages (package_id, content), as of ``spans`` over their members; members don't leave the task."""
    wanted = frozenset(names)

    def read(record):
        try:
            for part_path, raw, _ in _unzipped(record.content, ".xml"):
                yield from _part_spans(record.package_id, part_path, raw, wanted)
        except _BROKEN:
            return

    return map_columns(packages.select("package_id", "content"), read, SPANS)


@functools.lru_cache(4096)
def _ref(attributes: bytes) -> str | None:
    """What an element with these attributes is known by."""
    at = attributes_of(attributes.decode("utf-8", "replace"))
    return at.get("id", at.get("paraId", at.get("val")))


def _part_spans(package_id: int | None, part_path: str, raw: bytes, wanted: frozenset[str]) -> Iterator[tuple]:
    """The columns of SPANS for the elements of a part."""
    tags = scan(raw)
    found = tree(tags)
    if found.error:
        return
    names = tags.names
    chosen = np.array([names[k] in wanted for k in found.tag.tolist()], bool)
    if not chosen.any():
        return
    at, above, close = found.tag[chosen], found.parent[chosen], found.close[chosen]
    ends = np.zeros(len(tags), np.int64)
    ends[found.tag] = tags.end[found.close]
    end = ends[at]
    start, inner, inner_end = tags.start[at].tolist(), tags.end[at].tolist(), np.where(close == at, end, tags.start[close]).tolist()
    k, name_end = at.tolist(), tags.name_end[at].tolist()
    name = [names[i] for i in k]
    qualified = [raw[a + 1 : b] for a, b in zip(start, name_end, strict=True)]
    prefixes = {q: (text := q.decode("utf-8", "replace"))[: len(text) - len(n)] for q, n in zip(qualified, name, strict=True)}
    ref = [_ref(raw[a:b]) if a < b else None for a, b in zip(name_end, (tags.end[at] - 1 - tags.empty[at]).tolist(), strict=True)]
    text = [unescape(raw[a:b].decode("utf-8", "replace"), _NAMED) if n in ("t", "delText") else None for n, a, b in zip(name, inner, inner_end, strict=True)]
    inside = (above >= 0).tolist()
    of_parent = lambda values: [v if yes else None for v, yes in zip(values, inside, strict=True)]
    parent = above.tolist()
    yield (
        [package_id] * len(k), [part_path] * len(k), k, of_parent(parent), found.depth[chosen].tolist(), name, [prefixes[q] for q in qualified], start, inner, inner_end, end.tolist(), ref, text,
        of_parent([names[i] for i in parent]), of_parent(tags.start[above].tolist()), of_parent(ends[above].tolist()),
    )


def prose_leaves(members: DataFrame) -> DataFrame:
    """Leaves and opaque blocks of every prose part."""

    def read(record):
        part = _PROSE_PART.fullmatch(record.part_path)[1]
        yield from ((record.package_id, part, *leaf) for leaf in leaves_of(record.content, part))

    wanted = members.filter(F.col("part_path").rlike(f"^{_PROSE_PART.pattern}$"))
    return map_records(wanted.select("package_id", "part_path", "content"), read, LEAVES)


def prose_part(part_path: Column) -> Column:
    """The part that a member is, if it holds prose; else null."""
    found = F.regexp_extract(part_path, f"^{_PROSE_PART.pattern}$", 1)
    return F.when(found != "", found)


def prose_items(members: DataFrame) -> DataFrame:
    """Items of every prose part, with their position in it."""

    def read(record):
        part = _PROSE_PART.fullmatch(record.part_path)[1]
        for position, i in enumerate(items_of(record.content, part)):
            revisions = [dict(zip(("kind", "w_id", "author", "date"), r, strict=True)) for r in i.revisions]
            yield record.package_id, part, record.part_no, i.paragraph_id, i.paragraph_order, position, i.item, i.text, i.style, i.ref, revisions

    wanted = members.filter(F.col("part_path").rlike(f"^{_PROSE_PART.pattern}$"))
    return map_records(wanted.select("package_id", "part_path", "part_no", "content"), read, ITEMS)


def comment_entries(members: DataFrame) -> DataFrame:
    """Entries of the comments part."""

    def read(record):
        yield from ((record.package_id, *c) for c in comments_of(record.content))

    wanted = members.filter("part_path = 'word/comments.xml'")
    return map_records(wanted.select("package_id", "part_path", "content"), read, COMMENTS)


def extended_entries(members: DataFrame) -> DataFrame:
    """Entries of the extended comments part: package_id, para_id, done."""
    wanted = members.filter("part_path = 'word/commentsExtended.xml'")
    entries = F.explode(F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit("<[a-z0-9]*:?commentEx [^>]*>"), 0)).alias("e")
    of = lambda name: F.regexp_extract("e", f'{name}="([^"]*)"', 1)
    return wanted.select("package_id", entries).select("package_id", of("paraId").alias("para_id"), (of("done") == "1").alias("done"))


_RELATIONSHIP = """<(?:[A-Za-z0-9_]+:)?Relationship(?=[\\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""


def _attribute(tag: str, name: str) -> Column:
    """An attribute's value in either kind of quotes; empty if there is none."""
    of = lambda quote: F.regexp_extract(tag, f"\\s{name}\\s*=\\s*{quote}([^{quote}]*+){quote}", 1)
    return xml_unescape(F.concat(of('"'), of("'")))


def relationships(members: DataFrame) -> DataFrame:
    """Relationships of all parts: package_id, rels_path, source_path, rel_id, type (the end of its URI), target, external, target_path.

    Targets are resolved against the source part's folder, which is the package's
    for its own relationships; external targets and places in the same part have no path.
    """
    markup = F.regexp_replace(F.decode("content", "UTF-8"), "(?s)<!--.*?-->", "")
    rels = members.filter(F.col("part_path").endswith(".rels")).select("package_id", F.col("part_path").alias("rels_path"), F.explode(F.regexp_extract_all(markup, F.lit(_RELATIONSHIP), 0)).alias("r"))
    folder = F.regexp_extract("rels_path", "^(.*?)/?_rels/[^/]*$", 1)
    source = F.concat_ws("/", F.when(folder != "", folder), F.regexp_extract("rels_path", "([^/]*)[.]rels$", 1))
    found = rels.select("package_id", "rels_path", source.alias("source_path"), folder.alias("folder"), _attribute("r", "Id").alias("rel_id"), F.substring_index(_attribute("r", "Type"), "/", -1).alias("type"), _attribute("r", "Target").alias("target"), (_attribute("r", "TargetMode") == "External").alias("mode"))
    external = F.col("mode") | F.col("target").rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    inside = F.regexp_replace("target", "#.*$", "")
    path = F.when(~external & (inside != ""), resolve_target(F.col("folder"), inside))
    return found.withColumns({"external": external, "target_path": path}).drop("mode", "folder")


def broken_links(members: DataFrame) -> DataFrame:
    """package_id, missing_targets, cycles: internal targets that aren't there, and pairs of parts that link to each other."""
    links = relationships(members).filter("target_path is not null").select("package_id", "source_path", "target_path")
    missing = links.join(members.select("package_id", F.col("part_path").alias("target_path")).distinct(), ["package_id", "target_path"], "left_anti")
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    both = links.distinct().groupBy("package_id", pair("source_path", "target_path").alias("pair")).agg(F.count("*").alias("ways"))
    found = missing.select("package_id", F.lit(1).alias("missing"), F.lit(0).alias("cycle")).unionByName(both.filter("ways = 2").select("package_id", F.lit(0).alias("missing"), F.lit(1).alias("cycle")))
    return found.groupBy("package_id").agg(F.sum("missing").alias("missing_targets"), F.sum("cycle").alias("cycles"))


def package_stats(packages: DataFrame) -> DataFrame:
    """What limits apply to, for each package (package_id, content)."""

    def read(record):
        yield record.package_id, *stats_of(record.content or b"")

    return map_records(packages.select("package_id", "content"), read, STATS)


def images(members: DataFrame) -> DataFrame:
    """Images by relationship: package_id, rel_id, part_path, bytes, base64."""
    targets = relationships(members).select("package_id", "rel_id", F.col("target_path").alias("part_path"))
    media = members.filter(F.col("part_path").startswith("word/media/")).select("package_id", "part_path", "bytes", F.translate(F.base64("content"), "\r\n", "").alias("base64"))
    return targets.join(media, ["package_id", "part_path"])


def build_package(paragraphs: list[str], header: str = "", image: bytes = b"") -> bytes:
    """A small package with these paragraphs, a header and an image."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    parts = {
        "word/document.xml": f"<w:document><w:body>{body}</w:body></w:document>".encode(),
        "word/header1.xml": f"<w:hdr><w:p><w:r><w:t>{escape(header)}</w:t></w:r></w:p></w:hdr>".encode(),
        "word/_rels/document.xml.rels": b'<Relationships><Relationship Id="rId1" Type="image" Target="media/image1.png"/></Relationships>',
        "word/media/image1.png": image,
    }
    return write_package(parts)


WRITTEN = "package_id long, file string, bytes long"


def write_files(packages: DataFrame, folder: str) -> DataFrame:
    """Writes packages (package_id, path, content) below a shared folder, each as a file named by its path's digest and its own name."""
    from pyarrow import fs

    def write(record):
        system, root = fs.FileSystem.from_uri(folder)
        name = f"{hashlib.sha256(record.path.encode()).hexdigest()[:16]}-{record.path.rpartition('/')[2]}"
        with system.open_output_stream(f"{root}/{name}.part") as file:
            file.write(record.content)
        system.move(f"{root}/{name}.part", f"{root}/{name}")
        yield record.package_id, f"{folder}/{name}", len(record.content)

    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1])
    return map_records(packages.select("package_id", "path", "content"), write, WRITTEN)


def write_package(parts: dict[str, bytes]) -> bytes:
    """A zip package of these members, byte for byte the same for the same members."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, raw in parts.items():
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), raw, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def patch_package(content: bytes, changed: dict[str, bytes]) -> bytes:
    """The package with some members replaced; the others stay as they are stored."""
    return rewritten(content, changed)


#: Ids of paragraph marks' revisions in built packages begin here.
MARK_IDS = 1_000_000
_TYPES = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
_WORDS_OF_PARTS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _run(text: str, tag: str = "t", properties: str = "") -> str:
    return f'<w:r>{properties}<w:{tag} xml:space="preserve">{escape(text)}</w:{tag}></w:r>'


def _block(k: int, text: str, author: str) -> str:
    """A line as a block of a document: a paragraph, table, text box, content control, tracked or commented paragraph in turn."""
    first, _, rest = text.partition(" ")
    second, _, tail = rest.partition(" ")
    plain = lambda t: f"<w:p>{_run(t)}</w:p>"
    by = f'w:id="{k}" w:author={quoteattr(author)} w:date="2020-01-01T00:00:00Z"'
    match k % 6:
        case 0:
            return plain(text)
        case 1:
            return f"<w:tbl><w:tr><w:tc>{plain(first)}</w:tc><w:tc>{plain(rest)}</w:tc></w:tr></w:tbl>"
        case 2:
            return f"<w:p><w:r><w:drawing><w:txbxContent>{plain(text)}</w:txbxContent></w:drawing></w:r></w:p>"
        case 3:
            return f"<w:sdt><w:sdtContent>{plain(text)}</w:sdtContent></w:sdt>"
        case 4:
            bold = _run(first, properties="<w:rPr><w:b/></w:rPr>")
            kept, gone = f"<w:ins {by}>{_run(second)}</w:ins>", f'<w:del {by}><w:bookmarkStart w:id="{k}"/>{_run(tail, "delText")}<w:bookmarkEnd w:id="{k}"/></w:del>'
            mark = by.replace(f'w:id="{k}"', f'w:id="{MARK_IDS + k}"')
            return f"<w:p><w:pPr><w:rPr><w:ins {mark}/></w:rPr></w:pPr>{bold}{kept}{gone}</w:p>"
        case _:
            return f'<w:p><w:commentRangeStart w:id="{k}"/>{_run(text)}<w:commentRangeEnd w:id="{k}"/><w:r><w:commentReference w:id="{k}"/></w:r></w:p>'


def document_package(lines: list[str], author: str) -> bytes:
    """A package of all kinds of blocks, with a header, comments and their extended entries, an image and a link."""
    noted = [k for k in range(len(lines)) if k % 6 == 5]
    entries = "".join(f'<w:comment w:id="{k}" w:author={quoteattr(author)} w:date="2020-01-01T00:00:00Z"><w:p w14:paraId="{k:08X}">{_run(f"note {k}")}</w:p></w:comment>' for k in noted)
    extended = "".join(f'<w15:commentEx w15:paraId="{k:08X}" w15:done="{k % 2}"/>' for k in noted)
    blocks = "".join(_block(k, text, author) for k, text in enumerate(lines))
    parts = {
        "[Content_Types].xml": "<Types/>",
        "word/document.xml": f"<w:document {_WORDS_OF_PARTS}><w:body><!-- <w:p> -->{blocks}</w:body></w:document>",
        "word/header1.xml": f"<w:hdr><w:p>{_run(author)}</w:p></w:hdr>",
        "word/comments.xml": f"<w:comments>{entries}</w:comments>",
        "word/commentsExtended.xml": f"<w15:commentsEx>{extended}</w15:commentsEx>",
        "word/_rels/document.xml.rels": '<Relationships><Relationship Id="rId1" Type="' + _TYPES + 'image" Target="media/image1.png"/><Relationship Id="rId2" Type="' + _TYPES + 'hyperlink" Target="https://example.org/" TargetMode="External"/></Relationships>',
    }
    media = {"word/media/image1.png": "\n".join(lines).encode()}
    return write_package({name: xml.encode() for name, xml in parts.items()} | media)


def stored_members(packages: DataFrame) -> DataFrame:
    """How each member stands in its package: package_id, part_path, stored_sha256 over its header, data and directory record."""

    def read(record):
        try:
            yield from ((record.package_id, name, hashlib.sha256(raw).hexdigest()) for name, raw in stored_bytes(record.content or b"").items())
        except ValueError:
            return

    return map_records(packages.select("package_id", "content"), read, STORED)


def packages_from_texts(texts: DataFrame) -> DataFrame:
    """Packages (package_id, content) of rows (package_id, text, header): a block for each line."""

    def build(record):
        yield record.package_id, document_package(record.text.split("\n"), record.header or "")

    return map_records(texts.select("package_id", "text", "header"), build, PACKAGES)


def damaged(packages: DataFrame, damage: Column) -> DataFrame:
    """Packages (package_id, content) with what a column says done to them: no-zip, no-comments, cut-document, or null for nothing."""

    def hurt(record):
        yield record.package_id, _damaged(record.content, record.damage)

    return map_records(packages.select("package_id", "content", damage.alias("damage")), hurt, PACKAGES)


def _damaged(content: bytes, kind: str | None) -> bytes:
    if kind is None:
        return content
    if kind == "no-zip":
        return content[: len(content) // 2]
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        parts = {name: archive.read(name) for name in archive.namelist()}
    if kind == "no-comments":
        return write_package({name: raw for name, raw in parts.items() if name != "word/comments.xml"})
    return write_package(parts | {"word/document.xml": parts["word/document.xml"][: len(parts["word/document.xml"]) // 2]})


def with_header(packages: DataFrame, header: Column) -> DataFrame:
    """Packages (package_id, content) with another header part, all else as it was; a null header changes nothing."""

    def patch(record):
        changed = {} if record.header is None else {"word/header1.xml": record.header.encode()}
        yield record.package_id, patch_package(record.content, changed)

    return map_records(packages.select("package_id", "content", header.alias("header")), patch, PACKAGES)
