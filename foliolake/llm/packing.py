"""Best-fit packing of tokenized documents into sequences of a fixed size.

1. Every document is tokenized once, the end id is added, and it is cut into
   pieces: a document longer than a sequence gives whole sequences and one
   shorter piece, its first. Only lengths and checksums are written out.
2. Pieces are dealt by their turn in the task that cut them over so many tasks
   that each gets about ``PIECES_PER_TASK``, whatever their documents: rows
   without an id, or with one id, go to all tasks alike.
3. Each task runs bounded-space best-fit over its pieces, one after the other: a
   fixed number of open sequences, found through a bitset keyed by free space. A
   piece goes to the fullest open sequence in which it fits; if none fits, a new
   one is opened, and if too many are open, the fullest closes first.

The packing itself is online: it sees a piece once and never moves it. A task's
pieces come to it longest first, though, which makes it best-fit decreasing, the
tighter order. A task of ``PIECES_PER_TASK`` rarely has ``OPEN_SEQUENCES`` open
at once; the bound is what keeps memory fixed if it does.

A rerun gives the same result, as the order within a task is total.

Null and empty texts have one piece with the end id alone. Rows that repeat a
doc_id are separate documents (the checksum of all, then length, orders them).
An empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm import bpe
from foliolake.llm.storage import plain, table, written

CAPACITY = 1024
END_ID = 2
OPEN_SEQUENCES = 16_384
PIECES_PER_TASK = 65_536

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES = f"{PIECE}, turn long"
PLACED = f"{PIECE}, sequence_id long, offset long"
#: Pieces that a task holds before it hands them on.
_ROWS = 1 << 14


class OpenSequences:
    """At most ``most`` open sequences, in a bitset of their free spaces."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.count, self.closed = capacity, most, 0, 0
        self.bits = 0  # bit f is set if some open sequence has f places free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        at = self.by_free[free]
        sequence = at.pop()
        if not at:
            self.bits &= ~(1 << free)
        self.count -= 1
        return sequence

    def best_fit(self, length: int) -> tuple[int, int] | None:
        """Takes out the fullest sequence with ``length`` places free: (sequence, free)."""
        fitting = self.bits >> length
        if not fitting:
            return None
        free = length + ((fitting & -fitting).bit_length() - 1)
        return self._take(free), free

    def put(self, sequence: int, free: int) -> None:
        """Keeps a sequence open; a full one closes, and beyond the bound the fullest does (``closed`` counts these)."""
        if not free:
            return
        if self.count >= self.most:
            self.closed += 1
            fullest = (self.bits & -self.bits).bit_length() - 1
            if fullest >= free:
                return
            self._take(fullest)
        self.by_free[free].append(sequence)
        self.bits |= 1 << free
        self.count += 1


def best_fit(lengths: list[int], capacity: int = CAPACITY, most: int = OPEN_SEQUENCES, bins: OpenSequences | None = None, first: int = 0) -> tuple[list[int], list[int], int]:
    """Sequence and offset of each piece in turn, and the next unused sequence number."""
    bins = bins or OpenSequences(capacity, most)
    sequences, offsets = [], []
    for length in lengths:
        found = bins.best_fit(length)
        if found is None:
            found, first = (first, capacity), first + 1
        sequence, free = found
        sequences.append(sequence)
        offsets.append(capacity - free)
        bins.put(sequence, free - length)
    return sequences, offsets, first


def pieces_of(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids: whole sequences but for the first piece."""
    n = len(ids)
    head = n % capacity or min(n, capacity)
    cuts = [0, *range(head, n + 1, capacity)]
    raw = ids.astype("<u4")
    return [(k, a, b - a, zlib.crc32(raw[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document of ``docs`` (doc_id, text), each with its turn in its task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "turn"))])
        turn, rows = 0, []

        def frame() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for doc_id, ids in zip(doc_ids, encoder.encode_all(plain(batch.column("text")), end_id), strict=True):
                for piece in pieces_of(ids, capacity):
                    rows.append((doc_id, *piece, turn))
                    turn += 1
                if len(rows) >= _ROWS:
                    yield frame()
                    rows = []
        if rows:
            yield frame()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, most: int = OPEN_SEQUENCES, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Places pieces; adds sequence_id and offset. ``pieces`` should be a written table: it is counted first."""
    tasks = max(1, -(-pieces.count() // per_task))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        bins, used = OpenSequences(capacity, most), 0
        for batch in batches:
            sequences, offsets, used = best_fit(batch.column("length").to_pylist(), capacity, most, bins, used)
            placed = pa.array(np.array(sequences, dtype=np.int64) + base), pa.array(offsets, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *placed], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    dealt = pieces.repartition(tasks, "turn").sortWithinPartitions(F.desc("length"), "doc_id", "piece", "start", "ids_crc32", "turn")
    return dealt.mapInArrow(place, PLACED)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(written(tokenized_pieces(docs, capacity), "pieces"), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
