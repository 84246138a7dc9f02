"""A training-corpus pipeline: quality rules, near duplicates, decontamination, secrets, packing.

Each stage is a function of (spark, docs, sf_dir): docs is what the stage before
kept, with the columns of ``documents``; other tables are read below sf_dir. The
result is written as Parquet and read again as the next stage's docs. All but
the last stage return the columns of ``documents``; the last returns the packed
pieces.

- quality rules: rows that the rules reject go.
- near duplicates: of each group one row stays, that with the smallest doc_id.
- decontamination: rows with a word inside a benchmark window go.
- secrets: findings in the text are replaced by a mark; n_chars follows.
- packing: every document that is left is tokenized and packed.

The first three judge every row by itself: they write their input once with a
unique row key and drop rows by that key, so rows that share a doc_id, or have
none, don't share a verdict. Among near duplicates a null doc_id comes last, and
of rows that repeat a doc_id any one is first. Null texts count as empty.
Extra columns pass through all stages but the last. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm import decontamination, packing, quality_rules, secret_scan, simhash
from foliolake.llm.storage import keyed, table, without_ids, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    rows, key = keyed(docs)
    judged = quality_rules.judge(rows, table(spark, sf_dir, "labels"), carried=(key,))
    return without_ids(rows, judged.filter("not kept").select(key), key).drop(key)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id."""
    rows, key = keyed(docs)
    return without_ids(rows, simhash.copies(rows, key), key).drop(key)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark window."""
    rows, key = keyed(docs)
    found = decontamination.contamination(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without_ids(rows, found.filter("contaminated").select("doc_id"), key).drop(key)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced."""
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", secrets),
    ("best_fit_packing", pack),
]

#: The network of the secret scan and the hashes of the near duplicates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
