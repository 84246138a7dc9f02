"""Merkle fixity audit of WARC replicas.

A record's leaf is the SHA-256 of its bytes; records of a file are ordered by
offset, and ``FANOUT`` neighbours at a time make a node over their joint offset
range: the SHA-256 of first offset, length and the children's digests. The top
node is the file's root. Digests are computed where records are read; only
digests and offsets are shuffled. Each level is written before the next is made
of it, so that a level costs one exchange and a lost executor a file read.

An audit compares the roots of two replicas, then, level by level, the children
of nodes that differ, and so reads of the trees only what leads to damage. What
differs at the leaves is corrupt, what one tree lacks is missing.

Pages become WARC resource records, ordered by page_id, nulls first, then digest,
and cut into files of ``RECORDS_PER_FILE`` neighbours: a page_id that repeats, or
is null, in any number of rows goes on in as many files as it takes. Null urls
and pages are empty. Empty tables give empty trees and an empty audit. Extra
columns are dropped.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolake.llm.storage import table, written
from foliolake.operators.ranking import ranked

FANOUT = 16
RECORDS_PER_FILE = 4096
#: Bits of rot, cuts and losses in the replica that the registered query audits: by the first hex digits of a digest of the record's name.
ROTTEN, CUT, LOST = "00", "01", "02"
#: Bytes of the longest record that is read as one; and of a record's head.
MOST_RECORD, MOST_HEAD = 256 << 20, 1 << 20
_CHUNK, _BATCH = 1 << 18, 16 << 20

RAW = "path string, record_offset long, record_length long, uri string, record binary, error string"

_HEAD_END = re.compile(rb"\r?\n\r?\n")


class PlainBytes:
    """The plain bytes of a .warc or .warc.gz file, read as they are needed.

    ``data`` holds the bytes from ``place`` on. ``fill(n)`` reads until it holds
    n; it stops at the file's end, and where a gzip member is damaged, which
    ``damage`` then says. Reading goes on at the next member.
    """

    def __init__(self, file):
        self._file, self._size = file, file.size()
        self.data, self.place, self.damage = bytearray(), 0, None
        self._gzip = file.read_at(2, 0) == b"\x1f\x8b"
        self._at, self._from, self._member = 0, 0, None  # of the stored bytes: read so far, start of the member

    def fill(self, n: int) -> bool:
        while len(self.data) < n and self.damage is None and self._at < self._size:
            self._more()
        return len(self.data) >= n

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.place += n

    def _more(self) -> None:
        raw = self._file.read_at(min(_CHUNK, self._size - self._at), self._at)
        self._at += len(raw)
        if not self._gzip:
            self.data += raw
            return
        if self._member is None:
            self._member, self._from = zlib.decompressobj(31), self._at - len(raw)
        try:
            self.data += self._member.decompress(raw)
            if self._member.eof:
                self._at -= len(self._member.unused_data)
                self._member = None
            elif self._at >= self._size:
                raise zlib.error("cut off")
        except zlib.error as e:
            self.damage, self._member, self._at = f"gzip: {e}", None, self._next_member(self._from + 1)

    def _next_member(self, at: int) -> int:
        while at < self._size:
            raw = self._file.read_at(min(_CHUNK, self._size - at), at)
            found = raw.find(b"\x1f\x8b\x08")
            if found >= 0:
                return at + found
            at += max(len(raw) - 2, 1)
        return self._size


def _records(source: PlainBytes) -> Iterator[tuple[int, bytes, str | None, str | None]]:
    """Start, bytes, uri and error of every record.

    A bad one ends at the next line that starts with ``WARC/``, or at a damaged
    place; one beyond ``MOST_RECORD`` comes in several parts with errors.
    """
    while source.fill(1) or source.damage:
        if not source.data:
            yield source.place, b"", None, source.damage
            source.damage = None
            continue
        while not (head := _HEAD_END.search(source.data)) and len(source.data) < MOST_HEAD and source.fill(len(source.data) + 1):
            pass
        fields = {}
        for line in bytes(source.data[: head.start() if head else MOST_HEAD]).split(b"\n")[1:]:
            key, _, value = line.partition(b":")
            fields[key.strip().lower()] = value.strip()
        uri = fields[b"warc-target-uri"].decode("utf-8", "replace") if b"warc-target-uri" in fields else None
        size, error, end = fields.get(b"content-length", b""), None, 0
        if not source.data.startswith(b"WARC/"):
            uri, error = None, "no record"
        elif not head or not size.isdigit():
            error = "no Content-Length"
        else:
            end = head.end() + int(size) + 4
            if end > MOST_RECORD:
                error = "longer than a record may be"
            elif not source.fill(end) or source.data[end - 4 : end] != b"\r\n\r\n":
                error = "wrong Content-Length"
        if error:
            end = _bad_end(source)
        yield source.place, bytes(source.data[:end]), uri, error
        source.drop(end)


def _bad_end(source: PlainBytes) -> int:
    """How many of the bytes from here on belong to a bad record."""
    looked = 0
    while (found := source.data.find(b"\nWARC/", looked)) < 0:
        looked = max(0, len(source.data) - 5)
        if len(source.data) > MOST_RECORD:
            return looked
        if not source.fill(len(source.data) + 1):
            return len(source.data)
    return found + 1


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc and .warc.gz files: path, record_offset and record_length (of the plain bytes), uri, record, error.

    What is no whole record is a row with an error, up to the next line that
    starts with ``WARC/``; a damaged gzip member is a row of length 0. Spark lists
    the files; a task reads one of any size from end to end in bounded pieces, on
    file systems that pyarrow knows.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                system, at = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", name)))
                rows, held = [], 0
                with system.open_input_file(at) as file:
                    for start, record, uri, error in _records(PlainBytes(file)):
                        rows.append((name, start, len(record), uri, record, error))
                        held += len(record) + 1000
                        if held > _BATCH:
                            yield _batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(parse, RAW)


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in RAW.split(", ")])


def leaves_of(records: DataFrame) -> DataFrame:
    """Leaves (file, leaf, record_offset, record_length, sha256, uri) of records as ``read_warc`` gives them; a file is its path."""
    digests = written(records.select(F.col("path").alias("file"), "record_offset", "record_length", F.sha2("record", 256).alias("sha256"), "uri"), "warc-digests")
    order = Window.partitionBy("file").orderBy("record_offset", "record_length")
    return digests.withColumn("leaf", (F.row_number().over(order) - 1).cast("long"))


def render(page_id: Column, url: Column, page: Column) -> Column:
    """A WARC resource record, as a string whose UTF-8 bytes are the record. Pages have no date, so it is that of the epoch."""
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.octet_length(page).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, page, F.lit("\r\n\r\n"))


def manifest(records: DataFrame) -> DataFrame:
    """Leaves of records (rank, record_length and any more columns): file, leaf, record_offset besides."""
    filed = records.withColumns({"file": F.floor(F.col("rank") / RECORDS_PER_FILE), "leaf": F.col("rank") % RECORDS_PER_FILE}).drop("rank")
    order = Window.partitionBy("file").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    return filed.withColumn("record_offset", F.coalesce(F.sum("record_length").over(order), F.lit(0)))


def merkle_tree(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Nodes (file, level, node, first, length, digest); level 0 holds the leaves, each file's highest level its root.

    Pass a written table: it is read for each level that is made of it.
    """
    level = leaves.select("file", F.lit(0).alias("level"), F.col("leaf").alias("node"), F.col("record_offset").alias("first"), F.col("record_length").alias("length"), F.col("sha256").alias("digest"))
    most = leaves.agg(F.max("leaf")).first()[0] or 0
    tree, depth = level, 0
    while most > 0:
        depth, most = depth + 1, most // fanout
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))  # at most fanout
        grouped = level.groupBy("file", F.floor(F.col("node") / fanout).alias("node")).agg(F.min("first").alias("first"), F.sum("length").alias("length"), children.alias("c"))
        digest = F.sha2(F.concat_ws("|", F.col("first").cast("string"), F.col("length").cast("string"), F.array_join(F.col("c.digest"), "|")), 256)
        level = written(grouped.select("file", F.lit(depth).alias("level"), "node", "first", "length", digest.alias("digest")), f"warc-level-{depth}")
        tree = tree.unionByName(level)
    return tree


def audit(ours: DataFrame, theirs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Leaves that differ between two trees: file, node, digest, other_digest, status (corrupt, missing, extra).

    Pass trees of written tables: every level is a join of the nodes below
    differing ones, which are written before the next level is looked at.
    """
    depth = max([d for t in (ours, theirs) if (d := t.agg(F.max("level")).first()[0]) is not None], default=0)
    at = lambda tree, level: tree.filter(F.col("level") == level).select("file", "node", "digest")
    differing = None
    for level in range(depth, -1, -1):
        mine, other = at(ours, level), at(theirs, level).withColumnRenamed("digest", "other_digest")
        if differing is not None:
            parents = differing.select("file", F.col("node").alias("parent"))
            below = lambda nodes, p=parents: nodes.withColumn("parent", F.floor(F.col("node") / fanout)).join(p, ["file", "parent"], "left_semi").drop("parent")
            mine, other = below(mine), below(other)
        differing = written(mine.join(other, ["file", "node"], "full_outer").filter(~F.col("digest").eqNullSafe(F.col("other_digest"))), f"warc-differing-{level}")
    status = F.when(F.col("other_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("corrupt")
    return differing.withColumn("status", status)


def audit_pages(pages: DataFrame) -> DataFrame:
    """The fixity of a damaged replica of the pages' archive, a row for each record.

    The replica has the records at the offsets of the archive's manifest; where
    the name's digest says so, a byte has rotted, the end is cut off, or all is lost.
    """
    page = F.coalesce(F.col("html"), F.lit(""))
    name = F.sha2(F.concat_ws(" ", F.col("page_id").cast("string"), F.col("url")), 256).alias("name")
    records = pages.select("page_id", name, render(F.col("page_id"), F.col("url"), page).alias("record"))
    mark = F.substring("name", 1, 2)
    damaged = F.when(mark == ROTTEN, F.concat(F.lit("X"), F.expr("substring(record, 2)"))).when(mark == CUT, F.expr("left(record, length(record) - 7)")).when(mark == LOST, F.lit(None)).otherwise(F.col("record"))
    digests = records.select("page_id", F.octet_length("record").cast("long").alias("record_length"), F.sha2("record", 256).alias("sha256"), F.sha2(damaged, 256).alias("found"))
    # digests are written first: ordering looks at its input twice
    leaves = written(manifest(ranked(written(digests, "warc-digests"), ["page_id", "sha256", "found"])), "warc-manifest")
    replica = leaves.filter("found is not null").select("file", "leaf", "record_offset", "record_length", F.col("found").alias("sha256"))
    hurt = audit(merkle_tree(leaves), merkle_tree(replica)).select("file", F.col("node").alias("leaf"), "other_digest", "status")
    return leaves.join(hurt, ["file", "leaf"], "left").select(
        "page_id",
        F.col("file").alias("warc_file"),
        F.col("leaf").alias("record_no"),
        "record_offset",
        "record_length",
        "sha256",
        F.coalesce("status", F.lit("intact")).alias("status"),
        F.when(F.col("status").isNull(), F.col("sha256")).otherwise(F.col("other_digest")).alias("replica_sha256"),
    )


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_pages(table(spark, sf_dir, "pages"))


ORACLE_SQL = f"""
WITH r AS (SELECT page_id, sha256(concat_ws(' ', CAST(page_id AS VARCHAR), url)) AS name,
  concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Date: 1970-01-01T00:00:00Z', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', coalesce(CAST(page_id AS VARCHAR), 'none'),
    '>', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'Content-Type: text/html; charset=UTF-8', chr(13), chr(10),
    'Content-Length: ', CAST(strlen(coalesce(html, '')) AS VARCHAR), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS rec FROM pages),
d AS (SELECT page_id, CAST(strlen(rec) AS BIGINT) AS len, sha256(rec) AS sha, left(name, 2) AS mark,
  CASE left(name, 2) WHEN '{ROTTEN}' THEN sha256(concat('X', substring(rec, 2))) WHEN '{CUT}' THEN sha256(left(rec, length(rec) - 7)) WHEN '{LOST}' THEN NULL ELSE sha256(rec) END AS found FROM r),
n AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, sha, found NULLS FIRST) - 1 AS rank FROM d)
SELECT page_id, CAST(rank // {RECORDS_PER_FILE} AS BIGINT) AS warc_file, CAST(rank % {RECORDS_PER_FILE} AS BIGINT) AS record_no,
  CAST(coalesce(sum(len) OVER (PARTITION BY rank // {RECORDS_PER_FILE} ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset, len AS record_length, sha AS sha256,
  CASE mark WHEN '{ROTTEN}' THEN 'corrupt' WHEN '{CUT}' THEN 'corrupt' WHEN '{LOST}' THEN 'missing' ELSE 'intact' END AS status, found AS replica_sha256
FROM n
"""
