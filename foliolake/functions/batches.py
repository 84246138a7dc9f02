"""Python functions of single records inside tasks, in memory that doesn't follow the size of Spark's batches."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StringType, StructType

#: Records that are Python objects at once, and rows and bytes of strings that are handed over together (a single row may be larger).
RECORDS, ROWS, BYTES = 32, 4096, 4 << 20


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows as named tuples, of which few are there at once."""
    for batch in batches:
        record = namedtuple("record", batch.schema.names)
        for at in range(0, batch.num_rows, RECORDS):
            yield from map(record._make, zip(*[column.to_pylist() for column in batch.slice(at, RECORDS).columns], strict=True))


def _wide(schema: StructType) -> list[int]:
    return [k for k, field in enumerate(schema) if isinstance(field.dataType, (BinaryType, StringType))]


def batches_of(function: Callable[[tuple], Iterable[tuple]], schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from a record to rows as one from Arrow batches to Arrow batches of at most ROWS rows and about BYTES."""
    kind, wide = to_arrow_schema(schema), _wide(schema)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for record in _records(batches):
            for row in function(record):
                rows.append(row)
                for k in wide:
                    size += len(row[k] or "")
                if len(rows) >= ROWS or size >= BYTES:
                    yield packed(rows)
                    rows, size = [], 0
        if rows:
            yield packed(rows)

    return run


def column_batches_of(function: Callable[[tuple], Iterable[tuple]], schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Like ``batches_of`` for a function that gives groups of rows, each as one list for each column: no row is an object."""
    kind, wide = to_arrow_schema(schema), _wide(schema)

    def packed(columns: list[list]) -> Iterator[pa.RecordBatch]:
        whole = pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(columns, kind, strict=True)], schema=kind)
        yield from (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [[] for _ in kind], 0
        for record in _records(batches):
            for columns in function(record):
                for column, more in zip(held, columns, strict=True):
                    column += more
                size += sum(len(x) for k in wide for x in columns[k] if x)
                if len(held[0]) >= ROWS or size >= BYTES:
                    yield from packed(held)
                    held, size = [[] for _ in kind], 0
        yield from packed(held)

    return run


def map_records(frame: DataFrame, function: Callable[[tuple], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that a function makes of each record (a named tuple of the frame's columns)."""
    return frame.mapInArrow(batches_of(function, StructType.fromDDL(schema)), schema)


def map_columns(frame: DataFrame, function: Callable[[tuple], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that a function makes of each record as groups of columns."""
    return frame.mapInArrow(column_batches_of(function, StructType.fromDDL(schema)), schema)
