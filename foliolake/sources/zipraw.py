"""The directory of a zip file, read by ranges, and archives rewritten with untouched members copied as they are stored."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from typing import NamedTuple

#: (offset, size) to bytes.
Read = Callable[[int, int], bytes]

# Fixed values of the zip format: signatures, sizes of the fixed parts of records, and places of fields in them.
_END, _RECORD, _LOCAL = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04"
_END_SIZE, _RECORD_SIZE, _LOCAL_SIZE, _MOST_COMMENT = 22, 46, 30, 0xFFFF
_WIDE = 0xFFFFFFFF
_DESCRIPTOR, _UTF8, _ENCRYPTED = 0x8, 0x800, 0x1


class Entry(NamedTuple):
    """A member: its name, how it is stored, where its local header is, and its record in the directory."""

    name: str
    flags: int
    method: int
    crc: int
    packed: int
    size: int
    at: int
    record: bytes


class Directory(NamedTuple):
    entries: list[Entry]
    start: int
    end: bytes  # the end record with the archive's comment


def directory(read: Read, length: int) -> Directory:
    """The members of an archive; reads its tail and the directory, and nothing else."""
    tail_at = max(0, length - _END_SIZE - _MOST_COMMENT)
    tail = read(max(tail_at, length - 4096), min(length, 4096))  # a comment is rare
    if tail_at < length - len(tail) and tail[-_END_SIZE : 4 - _END_SIZE] != _END:
        tail = read(tail_at, length - tail_at)
    found = tail.rfind(_END)
    # a comment may hold the mark: the end record is the last whose comment ends with the file
    while found >= 0 and not (len(tail) - found >= _END_SIZE and found + _END_SIZE + struct.unpack_from("<H", tail, found + 20)[0] == len(tail)):
        found = tail.rfind(_END, 0, found)
    if found < 0:
        raise ValueError("no end of a zip directory")
    end = tail[found:]
    count, size, start = struct.unpack_from("<HII", end, 10)
    if _WIDE in (size, start) or start + size > length:
        raise ValueError("a zip directory that isn't inside the file, or a zip64 one")
    at = length - len(tail)
    records = tail[start - at : start - at + size] if start >= at else read(start, size)
    entries, place = [], 0
    for _ in range(count):
        if records[place : place + 4] != _RECORD:
            raise ValueError("a broken zip directory")
        flags, method = struct.unpack_from("<HH", records, place + 8)
        crc, packed, plain, name_size, extra_size, comment_size = struct.unpack_from("<IIIHHH", records, place + 16)
        (local,) = struct.unpack_from("<I", records, place + 42)
        if _WIDE in (packed, plain, local):
            raise ValueError("a zip64 member")
        name = records[place + _RECORD_SIZE : place + _RECORD_SIZE + name_size]
        whole = _RECORD_SIZE + name_size + extra_size + comment_size
        entries.append(Entry(name.decode("utf-8" if flags & _UTF8 else "cp437"), flags, method, crc, packed, plain, local, records[place : place + whole]))
        place += whole
    return Directory(entries, start, end)


def member(read: Read, entry: Entry) -> bytes:
    """A member's bytes; reads its local header and what it is stored as."""
    if entry.flags & _ENCRYPTED:
        raise ValueError("an encrypted member")
    head = read(entry.at, _LOCAL_SIZE)
    if len(head) < _LOCAL_SIZE or head[:4] != _LOCAL:
        raise ValueError("no member where the directory says")
    name_size, extra_size = struct.unpack_from("<HH", head, 26)
    stored = read(entry.at + _LOCAL_SIZE + name_size + extra_size, entry.packed)
    if entry.method == 0:
        raw = stored
    elif entry.method == 8:
        try:
            raw = zlib.decompress(stored, -15)
        except zlib.error as broken:
            raise ValueError(str(broken)) from broken
    else:
        raise ValueError(f"stored by method {entry.method}")
    if zlib.crc32(raw) != entry.crc:
        raise ValueError("a member's checksum is wrong")
    return raw


def of_bytes(content: bytes) -> Read:
    return lambda at, size: content[at : at + size]


def rewritten(content: bytes, changed: dict[str, bytes]) -> bytes:
    """The archive with some members' bytes replaced.

    All else is as it was, byte for byte: the other members as they are stored,
    with their headers, the order, dates and attributes of all, comments, and
    what lies between. Of members that share a name the last is replaced.
    """
    found = directory(of_bytes(content), len(content))
    last = {entry.name: k for k, entry in enumerate(found.entries)}
    new = {last[name]: raw for name, raw in changed.items() if name in last}
    if not new:
        return content
    order = sorted(range(len(found.entries)), key=lambda k: found.entries[k].at)
    ends = [found.entries[k].at for k in order[1:]] + [found.start]
    out = [content[: found.entries[order[0]].at]]
    at, places = len(out[0]), {}
    records = [entry.record for entry in found.entries]
    for k, end in zip(order, ends, strict=True):
        entry = found.entries[k]
        places[k] = at
        piece = content[entry.at : end]
        if k in new:
            raw = new[k]
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            stored = raw if entry.method == 0 else packer.compress(raw) + packer.flush()
            flags = entry.flags & ~_DESCRIPTOR
            name_size, extra_size = struct.unpack_from("<HH", piece, 26)
            sizes = struct.pack("<III", zlib.crc32(raw), len(stored), len(raw))
            piece = piece[:6] + struct.pack("<H", flags) + piece[8:14] + sizes + piece[26 : _LOCAL_SIZE + name_size + extra_size] + stored
            records[k] = entry.record[:8] + struct.pack("<H", flags) + entry.record[10:16] + sizes + entry.record[28:]
        out.append(piece)
        at += len(piece)
    records = [r[:42] + struct.pack("<I", places[k]) + r[46:] for k, r in enumerate(records)]
    size = sum(map(len, records))
    end = found.end[:12] + struct.pack("<II", size, at) + found.end[20:]
    between = content[found.start + sum(len(e.record) for e in found.entries) : len(content) - len(found.end)]
    return b"".join([*out, *records, between, end])


def stored_bytes(content: bytes) -> dict[str, bytes]:
    """Each member as it stands in the archive: its directory record without the offset, its local header and data."""
    found = directory(of_bytes(content), len(content))
    starts = sorted(entry.at for entry in found.entries)
    ends = dict(zip(starts, [*starts[1:], found.start], strict=True))
    return {e.name: e.record[:42] + e.record[46:] + content[e.at : ends[e.at]] for e in found.entries}
