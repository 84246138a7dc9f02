"""Token-id files with Elias-Fano encoded document boundaries.

Documents are dealt by ranges of doc_id (ties and nulls by their place in the
table, so one id never holds a task); each task encodes its documents in
ascending doc_id order and appends them to files of about ``IDS_PER_FILE`` ids in
the shared folder. A file is little-endian:

    magic ``FLEF``, version u32,
    ids: documents joined, u16 or u32, padded to 8 bytes,
    doc_ids i64[documents],
    lower parts: documents * low bits, packed, padded to 8 bytes,
    upper parts: u64 words, one set bit for each document at (end >> low) + k,
    samples: u64, place of every 256th set bit,
    trailer: documents u64, ids u64, place of doc_ids u64, words of the upper
    part u64, samples u64, width u32 (bytes of an id), low u32 (bits), ``FLEF``.

Ids are written as they come and the index after them, so a task holds two
numbers a document and a batch of ids, however long a document is.

The k-th end is read by a select on the upper part: start at the sample below k,
count set bits word by word, then add the k-th lower bits. That takes about
2 + low bits a document and no table of 64-bit offsets. A document's ids stand
between the ends k - 1 and k; reading selects both.

Files are named at random for each attempt of a task, and only those that the
manifest (a small Parquet table, published by Spark's committer) names count: a
lost executor leaves a file that nothing reads. Paths are of any file system that
pyarrow knows. Reading needs one task for each file.

Null and empty texts hold the end id alone. A null doc_id sorts first; rows with
one doc_id keep the table's order. An empty table gives no file. Extra columns
are dropped.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolake.llm import bpe
from foliolake.llm.storage import filled, plain, restored, scratch_dir, shuffle_width, table, written

END_ID = 0
IDS_PER_FILE = 1 << 25
#: Documents of a range, at least as many ranges as the session's shuffles have.
DOCS_PER_RANGE = 1 << 17
SAMPLE = 256
MAGIC = b"FLEF"
VERSION = 2
_HEAD = struct.Struct("<4sI")
_TRAILER = struct.Struct("<QQQQQII4s")
_CHUNK_IDS = 1 << 20

MANIFEST = "part int, file int, path string, documents long, n_ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence in near-minimal space, with select."""

    def __init__(self, low: int, count: int, lower: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.low, self.count, self.lower, self.upper, self.samples = low, count, lower, upper, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        count = len(values)
        universe = int(values[-1]) + 1 if count else 1
        low = max(0, (universe // max(count, 1)).bit_length() - 1)
        shifts = np.arange(low, dtype=np.uint64)
        bits = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
        lower = np.packbits(bits, bitorder="little")
        places = (values >> np.uint64(low)).astype(np.int64) + np.arange(count)
        length = int(places[-1]) + 1 if count else 0
        flags = np.zeros(-(-length // 64) * 64, dtype=np.uint8)
        flags[places] = 1
        upper = np.packbits(flags, bitorder="little").view("<u8")
        return cls(low, count, lower, upper, places[::SAMPLE].astype("<u8"))

    def _select(self, k: int) -> int:
        """The place of the k-th set bit of the upper part."""
        place = int(self.samples[k // SAMPLE])
        left = k % SAMPLE
        at = place // 64
        word = int(self.upper[at]) >> (place % 64) << (place % 64)
        while (here := word.bit_count()) <= left:
            left -= here
            at += 1
            word = int(self.upper[at])
        for _ in range(left):
            word &= word - 1
        return at * 64 + (word & -word).bit_length() - 1

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < self.count:
            raise IndexError(k)
        first = k * self.low
        held = self.lower[first // 8 : (first + self.low + 7) // 8].tobytes()
        lower = int.from_bytes(held, "little") >> (first % 8) & ((1 << self.low) - 1)
        return (self._select(k) - k) << self.low | lower


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the place in it of a path as Spark spells it."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", path)))


class TokenFileWriter:
    """Appends documents to one file; ``close`` writes the index."""

    def __init__(self, path: str, width: int):
        system, at = _located(path)
        system.create_dir(at.rpartition("/")[0], recursive=True)
        self._out = system.open_output_stream(at)
        self._out.write(_HEAD.pack(MAGIC, VERSION))
        self.path, self.width, self.n_ids = path, width, 0
        self.doc_ids: list[int] = []
        self._ends: list[int] = []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self._out.write(ids.astype(f"<u{self.width}").tobytes())
        self.n_ids += len(ids)
        self.doc_ids.append(doc_id)
        self._ends.append(self.n_ids)

    def close(self) -> None:
        ends = EliasFano.of(np.array(self._ends, dtype=np.uint64))
        size = _HEAD.size + self.n_ids * self.width
        lower = ends.lower.tobytes()
        index = size + -size % 8
        self._out.write(bytes(-size % 8) + np.array(self.doc_ids, dtype="<i8").tobytes())
        self._out.write(lower + bytes(-len(lower) % 8) + ends.upper.tobytes() + ends.samples.tobytes())
        self._out.write(_TRAILER.pack(len(self.doc_ids), self.n_ids, index, len(ends.upper), len(ends.samples), self.width, ends.low, MAGIC))
        self._out.close()


class TokenFile:
    """A file, opened for reading: its index is read, its ids stay where they are until they are asked for."""

    def __init__(self, path: str):
        system, at = _located(path)
        self._file = system.open_input_file(at)
        size = self._file.size()
        head = self._file.read_at(_HEAD.size, 0)
        if size < _HEAD.size + _TRAILER.size or _HEAD.unpack(head) != (MAGIC, VERSION):
            raise ValueError(f"{path} is no token file")
        documents, self.n_ids, index, words, n_samples, self.width, low, magic = _TRAILER.unpack(self._file.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is cut off")
        raw = self._file.read_at(size - _TRAILER.size - index, index)
        self.doc_ids = np.frombuffer(raw, "<i8", documents)
        at = 8 * documents
        n_lower = -(-documents * low // 8)
        lower = np.frombuffer(raw, np.uint8, n_lower, at)
        at += n_lower + -n_lower % 8
        upper = np.frombuffer(raw, "<u8", words, at)
        self.ends = EliasFano(low, documents, lower, upper, np.frombuffer(raw, "<u8", n_samples, at + 8 * words))
        self._held, self._first = np.zeros(0, f"<u{self.width}"), 0

    def __len__(self) -> int:
        return len(self.doc_ids)

    def bounds(self, k: int) -> tuple[int, int]:
        """Where document k begins and ends among the file's ids: two selects."""
        return (self.ends[k - 1] if k else 0), self.ends[k]

    def chunks(self, k: int, ahead: int = 0) -> Iterator[np.ndarray]:
        """The ids of document k, in chunks of bounded size; ``ahead`` ids are read at once for documents that follow."""
        start, end = self.bounds(k)
        for at in range(start, end, _CHUNK_IDS):
            n = min(_CHUNK_IDS, end - at)
            if at < self._first or at + n > self._first + len(self._held):
                wanted = min(max(n, ahead), self.n_ids - at)
                self._held, self._first = np.frombuffer(self._file.read_at(wanted * self.width, _HEAD.size + at * self.width), f"<u{self.width}"), at
            yield self._held[at - self._first : at - self._first + n]

    def ids(self, k: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, f"<u{self.width}"), *self.chunks(k)])


def write_token_files(docs: DataFrame, folder: str, end_id: int = END_ID, ids_per_file: int = IDS_PER_FILE, docs_per_range: int = DOCS_PER_RANGE) -> DataFrame:
    """Writes ``docs`` (doc_id, text) as files below ``folder`` and returns their manifest, in the order of (part, file)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, made, out = TaskContext.get().partitionId(), bpe.encoder(), 0, None
        width = 2 if encoder.n_vocab <= 1 << 16 else 4

        def closed() -> pa.RecordBatch:
            out.close()
            columns = [pa.array([part], pa.int32()), pa.array([made], pa.int32()), pa.array([out.path]), pa.array([len(out.doc_ids)]), pa.array([out.n_ids])]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MANIFEST.split(", ")])

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for doc_id, ids in zip(doc_ids, encoder.encode_all(plain(batch.column("text")), end_id), strict=True):
                out = out or TokenFileWriter(f"{folder}/part-{part:06d}-{made:04d}-{uuid.uuid4().hex}.flef", width)
                out.add(doc_id, ids)
                if out.n_ids >= ids_per_file:
                    yield closed()
                    out, made = None, made + 1
        if out:
            yield closed()

    rows = docs.select(filled(), "text", F.monotonically_increasing_id().alias("place"))
    ranges = max(shuffle_width(docs.sparkSession), -(-docs.count() // docs_per_range))
    ordered = rows.repartitionByRange(ranges, "doc_id", "place").sortWithinPartitions("doc_id", "place")
    return written(ordered.select("doc_id", "text").mapInArrow(encode, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, from the files that a manifest names.

    Starts need the ids of all files before: a running sum over one small row
    for each part, then over the files of a part.
    """
    sizes = manifest.select("part", "file", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = F.coalesce(F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.withColumn("within", within).join(parts.select("part", before.alias("before")), "part").select("part", "file", (F.col("before") + F.col("within")).alias("first"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                yield from _decoded(TokenFile(path), first)

    placed = manifest.select("part", "file", "path").join(firsts, ["part", "file"]).select("path", "first")
    spread = placed.repartition(max(1, min(shuffle_width(manifest.sparkSession), manifest.count())), "path")
    return spread.mapInArrow(decode, READ).withColumn("doc_id", restored())


def _decoded(file: TokenFile, first: int, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The rows of a file's documents; ``first`` ids stand in files before it."""
    for a in range(0, len(file), rows):
        here = range(a, min(a + rows, len(file)))
        bounds = [file.bounds(k) for k in here]
        crcs = []
        for k in here:
            crc = 0
            for chunk in file.chunks(k, ahead=_CHUNK_IDS):
                crc = zlib.crc32(chunk.astype("<u4").tobytes(), crc)
            crcs.append(crc)
        columns = [pa.array(file.doc_ids[a : a + len(here)]), pa.array([first + s for s, _ in bounds], pa.int64()), pa.array([e - s for s, e in bounds], pa.int64()), pa.array(crcs, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), scratch_dir(spark, "token-files")))
