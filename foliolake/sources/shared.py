"""Writing and publishing tables."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="foliolake-")


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below the one that the cluster shares (``spark.checkpoint.dir``).

    Where that isn't set, one machine (a ``local`` master, as in tests) uses a
    temporary folder; a cluster has no folder that all see, and that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/foliolake/{spark.conf.get('spark.app.id')}"


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Removes all that this application wrote to the shared folder; call it when its results have been written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: a lost executor costs a file read, not the work before it."""
    path = scratch(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish(df: DataFrame, path: str) -> DataFrame:
    """Writes a new version folder, which must not exist; Spark's committer makes it appear whole."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def published(df: DataFrame, path: str) -> bool:
    """Publishes a version unless there is one; says whether it did."""
    try:
        publish(df, path)
    except AnalysisException as there:
        if there.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        return False
    return True


def latest_version(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The newest whole version (``v1``, ``v2``, ...) below a path, and its number; the frame stays with that version."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    number = max(int(s.getPath().getName()[1:]) for s in system.listStatus(folder) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.parquet(f"{path}/v{number}"), number


def walked(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder tree: folder, name, kind (by the name's end), length; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    kind = F.when(F.col("name").rlike(r"\.(xml|rels)$"), "xml").when(F.col("name").rlike(r"\.(png|jpe?g|gif|emf)$"), "media").when(F.col("name").rlike(r"\.(txt|md|json|jsonl)$"), "text").otherwise("other")
    return files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length").withColumn("kind", kind)


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only file of JSON lines; lines that are torn or malformed are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
