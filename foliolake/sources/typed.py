"""The typed text form of a package: one block for each paragraph, with inline tokens for all but plain text.

    <!--@p id="P0" base="s_..."-->
    plain <span data-s="s_...">styled</span> <docx-revision id="7" kind="insert">new</docx-revision><docx-anchor id="3" kind="comment-start"/>

Text is escaped as in XML. Items come in and go out as rows: position, item
(text, opaque, or an anchor's kind), text, style_id, ref, kind and w_id of the
revision around it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.sax.saxutils import unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.functions.batches import map_records
from foliolake.functions.text import xml_escape

PARSED = "package_id long, paragraph_id string, position long, item string, text string, style_id string, ref string, kind string, w_id string, error string"
_TAG = re.compile(r"<(/?)([a-z-]+)((?:\s+[a-z-]+=\"[^\"]*\")*)\s*(/?)>")
_ATTRIBUTE = re.compile(r'([a-z-]+)="([^"]*)"')
_BLOCK = re.compile(r'<!--@p id="([^"]*)" base="([^"]*)"-->\n?(.*)', re.S)
_NAMED = {"&quot;": '"', "&apos;": "'"}


class TypedError(ValueError):
    """What is wrong with a typed text."""


def _token(item: Column, text: Column, style: Column, base: Column, ref: Column, kind: Column, w_id: Column) -> Column:
    """An item's markup."""
    plain = xml_escape(text)
    named = lambda name: F.concat(F.lit(f'<{name} id="'), xml_escape(F.coalesce(ref, F.lit("-"))), F.lit('" kind="'), item, F.lit('"/>'))
    styled = F.when(style == base, plain).otherwise(F.concat(F.lit('<span data-s="'), style, F.lit('">'), plain, F.lit("</span>")))
    inner = F.when(item == "text", styled).when(item == "opaque", named("docx-opaque")).otherwise(named("docx-anchor"))
    return F.when(kind.isNull(), inner).otherwise(F.concat(F.lit('<docx-revision id="'), xml_escape(w_id), F.lit('" kind="'), kind, F.lit('">'), inner, F.lit("</docx-revision>")))


def serialize(items: DataFrame) -> DataFrame:
    """package_id, typed of items (package_id, idx, paragraph_id, position, item, text, style_id, ref, kind, w_id).

    A paragraph's base style is that with most characters, the first on a tie.
    """
    weights = items.groupBy("package_id", "idx", "style_id").agg(F.sum(F.length("text")).alias("chars"), F.min("position").alias("first"))
    base = weights.groupBy("package_id", "idx").agg(F.max_by("style_id", F.struct("chars", -F.col("first"))).alias("base"))
    token = _token(*(F.col(c) for c in ("item", "text", "style_id", "base", "ref", "kind", "w_id"))).alias("token")
    rows = F.sort_array(F.collect_list(F.struct("position", token)))
    body = F.array_join(F.transform(rows, lambda r: r["token"]), "")
    head = F.concat(F.lit('<!--@p id="'), "paragraph_id", F.lit('" base="'), "base", F.lit('"-->\n'))
    paragraphs = items.join(base, ["package_id", "idx"]).groupBy("package_id", "idx", "paragraph_id", "base").agg(body.alias("body")).select("package_id", "idx", F.concat(head, "body").alias("block"))
    blocks = F.sort_array(F.collect_list(F.struct("idx", "block")))
    return paragraphs.groupBy("package_id").agg(F.concat(F.lit('<!--@typed schema="1"-->\n\n'), F.array_join(F.transform(blocks, lambda r: r["block"]), "\n\n")).alias("typed"))


def parse_inline(text: str, base: str) -> Iterator[tuple]:
    """(item, text, style, ref, kind, w_id) of each node of a paragraph's body. Ranges must nest and close."""
    style: str | None = None
    revisions: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        start = text.find("<", at)
        plain = text[at : start if start >= 0 else len(text)]
        around = revisions[-1] if revisions else (None, None)
        if plain:
            yield "text", unescape(plain, _NAMED), style or base, None, *around
        if start < 0:
            break
        found = _TAG.match(text, start)
        if not found:
            raise TypedError("unclosed or malformed tag")
        closing, name, raw, alone = bool(found[1]), found[2], dict(_ATTRIBUTE.findall(found[3])), bool(found[4])
        at = found.end()
        if name == "span":
            if closing == (style is None) or alone or (not closing and set(raw) != {"data-s"}):
                raise TypedError("a span must have a style, and spans don't nest")
            style = None if closing else raw["data-s"]
        elif name == "docx-revision":
            if closing and not revisions or style is not None or alone:
                raise TypedError("a revision must close, outside of spans")
            if closing:
                revisions.pop()
            elif raw.get("kind") not in ("insert", "delete", "move_from", "move_to") or "id" not in raw:
                raise TypedError("a revision has an id and a known kind")
            else:
                revisions.append((raw["kind"], unescape(raw["id"], _NAMED)))
        elif name in ("docx-anchor", "docx-opaque"):
            if closing or not alone or not raw.get("id") or not raw.get("kind"):
                raise TypedError(f"{name} closes itself and has an id and a kind")
            yield raw["kind"], "", base, None if raw["id"] == "-" else unescape(raw["id"], _NAMED), *around
        else:
            raise TypedError(f"unknown tag {name}")
    if style is not None or revisions:
        raise TypedError("an open range")


def parse_typed(text: str) -> Iterator[tuple]:
    """(paragraph_id, position, item, text, style, ref, kind, w_id) of a typed text."""
    head, *blocks = re.split(r"\n\n(?=<!--@p )", text)
    if not head.startswith('<!--@typed schema="1"'):
        raise TypedError("no header of a known schema")
    seen: set[str] = set()
    for block in blocks:
        found = _BLOCK.fullmatch(block)
        if not found or found[1] in seen:
            raise TypedError("a block without a marker, or a repeated paragraph")
        seen.add(found[1])
        yield from ((found[1], n, *node) for n, node in enumerate(parse_inline(found[3], found[2])))


def parse(typed: DataFrame) -> DataFrame:
    """The nodes of typed texts (package_id, typed); a text that can't be parsed is one row with an error."""

    def read(record):
        try:
            yield from [(record.package_id, *node, None) for node in parse_typed(record.typed)]
        except TypedError as wrong:
            yield record.package_id, *[None] * 8, str(wrong)

    return map_records(typed.select("package_id", "typed"), read, PARSED)
