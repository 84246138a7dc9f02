"""Column functions over text. All offsets count Unicode scalar values, from 0, end exclusive."""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The line ends that split lines (CR LF first).
LINE_ENDS = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"
EMU_PER_PIXEL = 9525
#: Words whose places are summed one by one; longer texts are summed by blocks of so many.
_BLOCK = 128
# The first and last regional indicator, the zero-width joiner, and the categories of marks.
REGIONAL, JOINER, MARKS = (0x1F1E6, 0x1F1FF), 0x200D, ("Mn", "Mc", "Me")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with ``value`` computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_starts(words: Column) -> Column:
    """The places of words in the text that they make, joined by one character, as an array of longs.

    A running sum inside the row: within blocks of words, then over the blocks.
    """
    zero = F.struct(F.array().cast("array<bigint>").alias("starts"), F.lit(0).cast("bigint").alias("at"))
    grown = lambda acc, size: F.struct(F.array_append(acc["starts"], acc["at"]).alias("starts"), (acc["at"] + size).alias("at"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / _BLOCK).cast("int")), lambda n: F.slice(words, n * _BLOCK + 1, F.lit(_BLOCK)))
    summed = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda acc, word: grown(acc, F.length(word).cast("bigint") + 1)))
    bases = lambda s: F.aggregate(s, zero, lambda acc, block: grown(acc, block["at"]), lambda acc: acc["starts"])
    shifted = lambda s: F.flatten(F.zip_with(s, bases(s), lambda block, base: F.transform(block["starts"], lambda at: at + base)))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(let(summed, shifted))


def cluster_starts(text: str) -> np.ndarray:
    """Where the grapheme clusters of a text begin, by what stands on both sides of a place, in linear time.

    A cluster goes on with marks and joiners, with whatever follows a joiner, from
    CR to LF, and from the first to the second of two regional indicators: in a run
    of those, every other place is a start, counted from the run's last start.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return np.zeros(0, np.int64)
    kinds, of = np.unique(codes, return_inverse=True)
    goes_on = np.array([k == JOINER or unicodedata.category(chr(k)) in MARKS for k in kinds.tolist()])[of]
    joined = np.append(False, codes[:-1] == JOINER) | np.append(False, (codes[:-1] == 13) & (codes[1:] == 10))
    starts = ~(goes_on | joined)
    starts[0] = True
    flag = (codes >= REGIONAL[0]) & (codes <= REGIONAL[1])
    if flag.any():
        # a run of indicators counts anew where one isn't preceded by another; one after a joiner is the first of its pair
        at = np.arange(len(codes))
        first = np.maximum.accumulate(np.where(flag & ~np.append(False, flag[:-1]), at, 0))
        starts &= ~(flag & ((at - first) % 2 == 1))
    return np.flatnonzero(starts)


def graphemes(text: Column) -> Column:
    """The grapheme clusters of a text; null for a null text."""

    @F.arrow_udf("array<string>")
    def clusters(texts: pa.Array) -> pa.Array:
        def cut(text: str) -> list[str]:
            return [text[a:b] for a, b in itertools.pairwise([*cluster_starts(text).tolist(), len(text)])]

        return pa.array([None if t is None else cut(t) for t in (x.as_py() for x in texts)], pa.list_(pa.string()))

    return clusters(text)


def grapheme_count(text: Column) -> Column:
    """The number of grapheme clusters of a text, as a long."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else len(cluster_starts(t)) for t in (x.as_py() for x in texts)], pa.int64())

    return count(text)


def sub(text: Column, start: Column, end: Column) -> Column:
    """text[start:end], clamped to the text."""
    first = F.greatest(start, F.lit(0))
    return F.substring(text, first + 1, F.greatest(F.least(end, F.length(text)) - first, F.lit(0)))


def occurrences(text: Column, part: Column | str) -> Column:
    """How often a non-empty literal occurs, without overlaps."""
    part = F.lit(part) if isinstance(part, str) else part
    return F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part))


def replace_at(text: Column, place: Column, old: Column, new: Column) -> Column:
    """The text with ``old``, which stands at ``place``, replaced."""
    return F.concat(sub(text, F.lit(0), place), new, sub(text, place + F.length(old), F.length(text)))


def xml_escape(text: Column) -> Column:
    """The five named entities; the ampersand first."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def xml_unescape(text: Column) -> Column:
    """The inverse: the ampersand last."""
    for plain, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def needs_space_attribute(text: Column) -> Column:
    """Whether the text begins or ends with a space, which XML drops unless told otherwise."""
    return text.rlike("^ | $")


def codepoint(char: Column) -> Column:
    """``U+`` and at least four hex digits of a character."""
    digits = F.hex(F.ascii(char))
    return F.concat(F.lit("U+"), F.lpad(digits, 8, "0").substr(F.least(F.lit(8) - F.length(digits), F.lit(4)) + 1, F.lit(8)))


def split_lines(text: Column) -> Column:
    """Lines of a text, cut at every kind of line end; an end at the very end makes no line."""
    lines = F.split(text, LINE_ENDS)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def local_name(qualified: Column) -> Column:
    return F.substring_index(qualified, ":", -1)


def emu_to_pixels(emu: Column) -> Column:
    return F.floor(emu / EMU_PER_PIXEL)


def context(text: Column, place: Column, before: int = 12, after: int = 13) -> Column:
    """The characters around one: ``before``, itself, and the rest of ``after``."""
    return sub(text, place - before, place + after)


def resolve_target(base: Column, target: Column) -> Column:
    """A relative relationship target against its base folder; ``..`` climbs, ``.`` and empty steps don't count."""
    steps = F.split(F.when(target.startswith("/"), target).otherwise(F.concat(base, F.lit("/"), target)), "/")
    climb = lambda path, step: (
        F.when(step == "..", F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))).when(step.isin("", "."), path).otherwise(F.concat(path, F.array(step)))
    )
    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), climb), "/")
