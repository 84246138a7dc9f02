"""One pass over the bytes of an XML part: its tags as arrays, and the element tree from one over the tags.

One expression finds what begins with a ``<`` before a name, a closing slash or a
mark. A tag ends at the next ``>`` if no other ``<`` and only whole pairs of one
kind of quote lie between, else at the first ``>`` outside quotes. Comments, CDATA,
instructions and declarations hide what they cover. A construct without an end is
text, and an end that isn't there is looked for once. Offsets count bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

#: A tag (whether it closes, its name) or the head of what hides what it covers.
_TOKEN = re.compile(
    rb"""<(?:(/?)(?=([^\s/>!?<"'=][^\s/><]*+))(?:[^<>"']*+(?:"[^<>"']*+"[^<>"']*+)*+>|[^<>"']*+(?:'[^<>"']*+'[^<>"']*+)*+>|[^\s/><]*+(?:[^>"'<]++|"[^"]*+"|'[^']*+')*+>)|(!--|!\[CDATA\[|\?|!))"""
)
_SLASH = ord("/")
#: How constructs that are no tags end, by their heads; a declaration ends like a tag.
_HIDING = {b"!--": b"-->", b"![CDATA[": b"]]>", b"?": b"?>", b"!": b">"}


@dataclass
class Tags:
    """Tags in order: local names, places (``end`` exclusive), where attributes begin, and what kind they are."""

    raw: bytes
    names: list[str]
    start: np.ndarray
    end: np.ndarray
    name_end: np.ndarray
    closing: np.ndarray
    empty: np.ndarray

    def __len__(self) -> int:
        return len(self.names)

    def attributes(self, k: int) -> str:
        return self.raw[self.name_end[k] : self.end[k] - 1 - bool(self.empty[k])].decode("utf-8", "replace")

    def text(self, a: int, b: int) -> str:
        """What stands between two places."""
        return self.raw[a:b].decode("utf-8", "replace")


def scan(raw: bytes) -> Tags:
    """The tags of an XML text."""
    names, start, end, name_end, closing, empty = [], [], [], [], [], []
    known: dict[bytes, str] = {}
    absent: set[bytes] = set()
    stop = raw.rfind(b">") + 1  # nothing ends behind it
    at: int | None = 0
    while at is not None:
        begun, at = at, None
        for token in _TOKEN.finditer(raw, begun, stop):
            a, b = token.span()
            name = token[2]
            if name is None:
                tail = _HIDING[token[3]]
                hidden = raw.find(tail, b) if tail not in absent else -1
                if hidden >= 0:
                    at = hidden + len(tail)
                    break
                absent.add(tail)
                continue
            if name not in known:
                known[name] = name.rpartition(b":")[2].decode("utf-8", "replace")
            names.append(known[name])
            start.append(a)
            end.append(b)
            name_end.append(token.end(2))
            closes = raw[a + 1] == _SLASH
            closing.append(closes)
            empty.append(not closes and raw[b - 2] == _SLASH)
    places = [np.array(x, np.int64) for x in (start, end, name_end)]
    return Tags(raw, names, *places, np.array(closing, bool), np.array(empty, bool))


@dataclass
class Tree:
    """Elements of an XML text up to its first fault: tag of each, parent's tag (-1: none), depth, end tag (-1: none)."""

    tag: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    close: np.ndarray
    error: str | None


def tree(tags: Tags) -> Tree:
    """Elements with their parents and end tags, by one pass with the open tags on a stack."""
    names, closing, empty = tags.names, tags.closing.tolist(), tags.empty.tolist()
    element, parent, depth, close = [], [], [], [-1] * len(names)
    opened: list[int] = []
    error = None
    for k, name in enumerate(names):
        if closing[k]:
            if not opened or names[opened[-1]] != name:
                error = f"unexpected </{name}>"
                break
            close[opened.pop()] = k
            continue
        element.append(k)
        parent.append(opened[-1] if opened else -1)
        depth.append(len(opened))
        if empty[k]:
            close[k] = k
        else:
            opened.append(k)
    if opened and error is None:
        error = f"<{names[opened[-1]]}> isn't closed"
    return Tree(*(np.array(x, np.int64) for x in (element, parent, depth, [close[k] for k in element])), error)
