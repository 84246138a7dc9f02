"""Main text of web pages by two passes of block rules.

Markup is read once, from front to back and tolerantly: comments, scripts and
styles are skipped, block-level tags end a block, inline tags don't. A block
knows its words, its characters, how many of these stand in links, and the
containers around it.

First pass. A block's support is its share of stop words; an ``article`` or
``main`` around it counts as ``INSIDE_SHARE`` more, and standing outside of a
page's ``article`` or ``main`` as ``OUTSIDE_SHARE`` less. By support, length and link density a
block is content (long, well supported), boilerplate (mostly links; or long and
badly supported, on a page where other blocks are well supported) or open: short
blocks and those in between. Containers that never hold the article (menus, page
headers and footers, sidebars, notices, adverts, forms, reader comments), known
by tag, role or class words, make a block boilerplate, whatever its words.

Second pass. An open block takes the label of the nearest block of its section
that the first pass decided by density, on a tie the one before, or, if it is a
heading, the one after; blocks in
boilerplate containers decide nothing for their neighbours. A section without a
decided block is content, but for what stands outside of a page's ``article`` or
``main``. If all blocks in these are boilerplate, they count for nothing and the
page is judged again.

Null and empty pages give an empty text. Broken markup is read as far as it
goes; the time for a page is in proportion to its length. Repeated rows stay; an
empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm.storage import plain, table

LINK_DENSITY = 0.5
STOP_LOW, STOP_HIGH = 0.05, 0.2
INSIDE_SHARE, OUTSIDE_SHARE = 0.15, 1.0
SHORT_CHARS, LONG_CHARS = 60, 140

# Stop words of the corpus's languages (English, German, French, Spanish). They are the closed word
# classes of school grammars: articles, the commonest prepositions, conjunctions and pronouns, and forms of "be" and
# "have". Other frequent words aren't listed, so that the list stays under 200 entries.
_STOP = frozenset(
    """a about all and any are as at be been but by can for from had has have he her his if in into is it its more not of
    on one or our out she so some than that the their them there they this to up was we were what when which who will
    with would you
    als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit
    nach nicht noch oder sich sie sind über um und von war wie zu zum zur
    au aux avec ce cette dans de des du elle en est et il la le les leur mais ne nous ou par pas plus pour qu que qui
    sa se ses son sont sur un une vous
    al como con del el entre era esta las lo los más no o para pero por ser si sin su sus también y""".split()
)
_SKIPPED = frozenset("script style noscript template iframe object svg math title select option textarea button canvas audio video map datalist".split())
_BOILERPLATE = frozenset("head nav footer aside form dialog menu fieldset".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
_REGION = frozenset(["article", "main"])
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_CLASS_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies
    consent disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice pager pagination popup
    login promo promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored
    subscribe subscription teaser toolbar topbar widget""".split()
)
#: Class names with one of these say how a container is laid out, not what it is.
_LAYOUT_WORDS = frozenset("has no with without layout wrapper".split())
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile("""["'>]""")
_NOT_WORD = re.compile(r"[^a-z0-9]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """Text between two block boundaries. region numbers the article or main around it, or is 0."""

    region: int
    boilerplate: bool
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    heading: bool = False
    label: str = "open"

    @functools.cached_property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())

    @functools.cached_property
    def stop_share(self) -> float:
        words = _WORD.findall(self.text.lower())
        return sum(w in _STOP for w in words) / max(1, len(words))

    @functools.cached_property
    def mostly_links(self) -> bool:
        return self.link_chars > 0 and self.link_chars > LINK_DENSITY * len("".join(self.text.split()))


class _Markup:
    """Finds the tags of a page, front to back.

    A ``>`` inside a quoted value doesn't end a tag. Once a tag's quotes leave no
    such end, the page's quotes aren't trusted any more, and the next ``>`` is
    the end; so every character is looked at a fixed number of times.
    """

    def __init__(self, page: str):
        self._page, self._quotes, self._last_end = page, True, page.rfind(">")
        self._last = {quote: page.rfind(quote) for quote in "\"'"}
        self._absent: set[str] = set()

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, closing, attributes) of the next tag, or of a comment or declaration, which have no name."""
        page = self._page
        while 0 <= (start := page.find("<", at)) < self._last_end:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), "", False, ""
            if page.startswith(("<!", "<?"), start):
                return start, page.find(">", start) + 1, "", False, ""
            closing = page.startswith("/", start + 1)
            if name := _NAME.match(page, start + 1 + closing):
                end = self._end(name.end())
                return (start, end + 1, name[0].lower(), closing, page[name.end() : end]) if end >= 0 else None
            at = start + 1
        return None

    def _end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose name ends here."""
        look = at
        while self._quotes and (found := _QUOTE_OR_END.search(self._page, look)):
            if found[0] == ">":
                return found.start()
            # a quote that no other follows is a character like any other
            look = self._page.find(found[0], found.end()) + 1 if found.start() < self._last[found[0]] else found.end()
        self._quotes = False
        return self._page.find(">", at)

    def after(self, at: int, tag: str) -> int:
        """The place after an element's end tag, or the page's end. An end tag that isn't there is looked for once."""
        if tag not in self._absent:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self._page, at)
            if end:
                return end.end()
            self._absent.add(tag)
        return len(self._page)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def _is_boilerplate(tag: str, raw: str, in_region: bool) -> bool:
    if tag in _BOILERPLATE or (tag == "header" and not in_region):
        return True
    if tag in ("html", "body", *_REGION) and not raw:
        return False
    at = _attributes(raw)
    if "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "") or at.get("role") in _ROLES:
        return True
    if tag in ("html", "body"):
        return False
    named = _CLASS_WORDS if in_region else _CLASS_WORDS | {"header"}
    for name in f"{at.get('class', '')} {at.get('id', '')}".split():
        words = set(_NOT_WORD.split(name))
        if words & named and not words & _LAYOUT_WORDS:
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The page's blocks that have any text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # container; boilerplate and region before it
    opened: Counter[str] = Counter()
    boilerplate, region, regions, links, at = False, 0, 0, 0, 0
    current, markup = Block(0, False), _Markup(page)

    def cut() -> None:
        nonlocal current
        if current.parts:
            out.append(current)
        current = Block(region, boilerplate)

    def text(raw: str) -> None:
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            current.parts.append(plain)
            if links:
                current.link_chars += len("".join(plain.split()))

    def leave(tag: str) -> None:
        """Closes the innermost container of this name, and what is open inside it."""
        nonlocal boilerplate, region, links
        while opened[tag]:
            name, boilerplate, region = stack.pop()
            opened[name] -= 1
            if name == tag:
                links = 0
                return

    while found := markup.next(at):
        start, end, tag, closing, attributes = found
        text(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag == "br":
            current.parts.append(" ")
        if tag in _INLINE:
            if tag not in ("a", "br") and not closing and tag not in _VOID and attributes and _is_boilerplate(tag, attributes, region > 0):
                at = markup.after(at, tag)
            continue
        if tag in _SKIPPED:
            if not closing and not attributes.endswith("/"):
                at = markup.after(at, tag)
                cut()
            continue
        if closing:
            leave(tag)
            cut()
            continue
        if opened["head"] and tag not in _VOID:
            leave("head")  # whose end tag may be left out
        if tag not in _VOID and tag not in ("p", "li", "dt", "dd") and not attributes.endswith("/"):
            stack.append((tag, boilerplate, region))
            opened[tag] += 1
            boilerplate = boilerplate or _is_boilerplate(tag, attributes, region > 0)
            if tag in _REGION and not region and not boilerplate:
                regions += 1
                region = regions
            cut()
            current.heading = tag in _HEADINGS
        else:
            cut()
            if attributes and _is_boilerplate(tag, attributes, region > 0):
                current.boilerplate = True
    text(page[at:])
    cut()
    return [b for b in out if b.text]


def _first_pass(blocks: list[Block], by_region: bool) -> None:
    """Labels what container, link density, length and stop words decide."""
    share = lambda block: block.stop_share + (INSIDE_SHARE if block.region else -OUTSIDE_SHARE) * by_region
    for block in blocks:
        if block.boilerplate:
            block.label = "boilerplate"
        elif block.mostly_links:
            # a short line of links inside an article may be part of it
            block.label = "open" if by_region and block.region and len(block.text) < SHORT_CHARS else "boilerplate"
        else:
            block.label = "content" if len(block.text) >= LONG_CHARS and share(block) >= STOP_HIGH else "open"
    supported = any(block.label == "content" for block in blocks)
    for block in blocks:
        if block.label == "open" and supported and len(block.text) >= LONG_CHARS and share(block) < STOP_LOW:
            block.label = "boilerplate"


def _nearest(blocks: list[Block], order: range, by_region: bool) -> list[tuple[int, str] | None]:
    """For each block, the distance and label of the nearest decided block passed before it in ``order``."""
    out: list[tuple[int, str] | None] = [None] * len(blocks)
    last: dict[int, tuple[int, str]] = {}
    for k in order:
        block = blocks[k]
        section = block.region if by_region else 0
        if section in last:
            out[k] = (abs(k - last[section][0]), last[section][1])
        if block.label != "open" and not block.boilerplate:
            last[section] = (k, block.label)
    return out


def _second_pass(blocks: list[Block], by_region: bool) -> None:
    """Open blocks take the label of their nearest decided neighbour."""
    before = _nearest(blocks, range(len(blocks)), by_region)
    after = _nearest(blocks, range(len(blocks) - 1, -1, -1), by_region)
    for block, near, ahead in zip(blocks, before, after, strict=True):
        if block.label == "open":
            default = "boilerplate" if by_region and not block.region else "content"
            pair = (ahead, near) if block.heading else (near, ahead)
            block.label = min((x for x in pair if x), key=lambda x: x[0], default=(0, default))[1]


def extract(page: str | None) -> str:
    """The main text of a whole page: content blocks, in order, joined by one space."""
    blocks = blocks_of(page or "")
    for by_region in [True, False] if any(b.region for b in blocks) else [False]:
        _first_pass(blocks, by_region)
        _second_pass(blocks, by_region)
        if text := " ".join(b.text for b in blocks if b.label == "content"):
            return text
    return ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""

    @F.arrow_udf("string")
    def main_text(raw: pa.Array) -> pa.Array:
        return pa.array([extract(page) for page in plain(raw)], pa.string())

    read = pages.select("page_id", "url", main_text("html").alias("text"))
    return read.withColumn("n_chars", F.length("text").cast("long"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
