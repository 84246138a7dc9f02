"""Digests and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def fingerprint12(text: Column) -> Column:
    """The first 12 hex digits of a text's SHA-256."""
    return F.substring(sha(text), 1, 12)


def revision_key(part: Column, kind: Column, w_id: Column, text: Column) -> Column:
    return F.concat_ws("|", part, kind, w_id, fingerprint12(text))


def parse_revision_key(key: Column) -> list[Column]:
    """part, kind, w_id, fingerprint; null where the key hasn't four fields."""
    fields = F.split(key, "\\|")
    good = F.size(fields) == 4
    return [F.when(good, F.get(fields, F.lit(i))).alias(name) for i, name in enumerate(("part", "kind", "w_id", "fingerprint"))]


def parse_paragraph_id(path: Column) -> list[Column]:
    """part, table, row, cell, box, control and paragraph of a paragraph's id; null where it has none."""
    part = F.regexp_extract(path, r"^(header[0-9]*|footer[0-9]*|footnotes|endnotes)\.", 1)
    number = lambda letter: F.regexp_extract(path, rf"(?:^|\.){letter}([0-9]+)(?:\.|$)", 1)
    fields = (("table", "T"), ("row", "R"), ("cell", "C"), ("box", "B"), ("control", "S"), ("paragraph", "P"))
    return [F.when(part != "", part).otherwise("document").alias("part"), *(F.when(number(x) != "", number(x).cast("long")).alias(name) for name, x in fields)]


def style_id(features: Column) -> Column:
    """``s_`` and 16 hex digits of the digest of a style's canonical spelling."""
    return F.concat(F.lit("s_"), F.substring(sha(features), 1, 16))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with keys in alphabetical order and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def digest_of_any_order(*columns: Column) -> Column:
    """An aggregate: a SHA-256 of the group's rows, each joined by ``:``, whatever their order.

    Digests of the rows are summed, so a group of any size needs one row for each task.
    """
    number = F.conv(F.substring(sha(F.concat_ws(":", *columns)), 1, 15), 16, 10).cast("decimal(38,0)")
    return sha(F.concat_ws(":", F.count("*").cast("string"), F.sum(number).cast("string")))


def digest_of_rows(*columns: Column) -> Column:
    """An aggregate: the SHA-256 of the group's rows, each joined by ``|``, in sorted order, joined by ``;``."""
    rows = F.sort_array(F.collect_list(F.concat_ws("|", *columns)))
    return sha(F.array_join(rows, ";"))
