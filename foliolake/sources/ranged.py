"""Word packages read by ranges: a Python data source that opens files, reads zip directories, and fetches only the members asked for.

``members(spark, folder)`` has the rows of ``docx.members`` with the file's path.
Filters on ``part_path`` (equal, in, starts or ends with) are pushed into the
source, so a member that they exclude is never fetched: of each file the tail,
the directory and the members asked for are read, whatever else is in it. Tasks
get files up to a bound of bytes and of files; a file that can't be read gives a
row with an error, which no filter on ``part_path`` returns.

Files are listed and opened by pyarrow's file systems (local folders, object
stores, HDFS); where only Spark reaches a store, ``docx.read_packages`` reads
whole files.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from foliolake.sources import docx, zipraw

SCHEMA = f"path string, {docx.MEMBERS}"
#: A task reads files up to so many bytes, or so many of them.
TASK_BYTES, TASK_FILES = 256 << 20, 4096
#: Rows of a batch hold up to so many bytes of contents, or one member.
BATCH_BYTES = 16 << 20
FORMAT = "word_members"


@dataclass
class Wanted:
    """What pushed filters say of part_path; all must hold."""

    tests: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)

    def push(self, given: Filter) -> bool:
        kinds = {EqualTo: "is", In: "is", StringStartsWith: "starts", StringEndsWith: "ends"}
        if type(given) not in kinds or given.attribute != ("part_path",):
            return False
        values = given.value if isinstance(given, In) else (given.value,)
        self.tests.append((kinds[type(given)], tuple(values)))
        return True

    def holds(self, name: str) -> bool:
        test = {"is": lambda v: name in v, "starts": lambda v: name.startswith(v), "ends": lambda v: name.endswith(v)}
        return all(test[kind](values) for kind, values in self.tests)


@dataclass
class Files(InputPartition):
    files: list[tuple[str, str, int]]  # URI, place in its file system, size


def wanted_members(read: zipraw.Read, length: int, wanted: Wanted) -> Iterator[tuple]:
    """part_path, part_no, bytes, sha256, content, error of an archive's members that are asked for."""
    try:
        entries = zipraw.directory(read, length).entries
    except ValueError as broken:
        if not wanted.tests:
            yield None, None, None, None, None, str(broken)
        return
    numbers = docx.part_numbers([e.name for e in entries])
    for entry in entries:
        if wanted.holds(entry.name):
            try:
                raw = zipraw.member(read, entry)
            except ValueError as broken:
                yield entry.name, numbers.get(entry.name), entry.size, None, None, str(broken)
            else:
                yield entry.name, numbers.get(entry.name), len(raw), hashlib.sha256(raw).hexdigest(), raw, None


class MemberReader(DataSourceReader):
    def __init__(self, folder: str, pattern: str):
        self.folder, self.pattern, self.wanted = folder, pattern, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.wanted.push(f)]

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.folder)
        scheme = self.folder.split(":", 1)[0] if re.match(r"[a-z0-9]+:", self.folder) else "file"
        name = re.compile(self.pattern)
        found = [(f"{scheme}:{x.path}" if scheme == "file" else f"{scheme}://{x.path}", x.path, x.size) for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and name.search(x.path)]
        out, size = [], 0
        for file in sorted(found):
            if not out or size + file[2] > TASK_BYTES or len(out[-1].files) == TASK_FILES:
                out.append(Files([]))
                size = 0
            out[-1].files.append(file)
            size += file[2]
        return out

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        """Rows of a task's files; a folder without any has one task without files."""
        from pyarrow import fs

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string() if " string" in c else pa.binary() if " binary" in c else pa.int64() for c in SCHEMA.split(", ")]
        rows, size = [], 0
        system = fs.FileSystem.from_uri(self.folder)[0]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for uri, place, length in partition.files if partition else []:
            package_id = xxhash.xxh64_intdigest(uri.encode(), 42)
            package_id -= (package_id >> 63) << 64
            with system.open_input_file(place) as file:
                for row in wanted_members(lambda at, n, file=file: file.read_at(n, at), length, self.wanted):
                    rows.append((uri, package_id, *row))
                    size += len(row[4] or b"")
                    if size >= BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class MemberSource(DataSource):
    """Options: path, and pattern of file names (by default those that end with .docx)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MemberReader:
        return MemberReader(self.options["path"], self.options.get("pattern", r"\.docx$"))


def members(spark: SparkSession, folder: str, pattern: str = r"\.docx$") -> DataFrame:
    """The members of all packages below a folder; filter by part_path to fetch only some."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MemberSource)
    return spark.read.format(FORMAT).option("pattern", pattern).load(folder)
