"""Exact duplicates by deterministic block naming, in DataFrame functions only.

A text's bytes are cut into blocks of a fixed size. Distinct blocks are sorted,
and a block's name is its place, an integer. Then pairs of adjacent names are
sorted and named in the same way, level by level, until one name is left of each
document: documents with one level and one name have equal texts, and others
don't, since every name stands for one pair and, at the bottom, for one content.
A last block without a neighbour is a pair with none. An empty or null text is
one empty block.

Contents are dealt once, to be named; documents find their blocks' names by a
128-bit address. That no address stands for two contents is checked in the named
table; if one did, all would be addressed anew with another seed. Names that
hold many rows are broadcast, and they are few by their share (``looked_up``):
copies by the million are one row of a small table.

Of equal texts the row with the largest doc_id stays; nulls are smaller than any
id, and of rows that repeat the largest doc_id one stays. Every row is returned,
repeated ones too; null texts equal empty ones. An empty table gives an empty
result. Extra columns are dropped.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm.storage import keyed, looked_up, table, without_ids, written

#: Bytes of a block.
BLOCK = 4096
#: Stands for the right one of a pair that has none; names are never negative.
NO_NAME = -1

ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER copies AS keep_id, count(*) OVER copies AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW copies AS (PARTITION BY coalesce(text, ''))
"""


def whole(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def blocks(size: int = BLOCK, text: str = "text") -> Column:
    """The blocks of a text's bytes, as an array; time in proportion to the text.

    The bytes are a variable of the outer function, as a column would be copied for each block.
    """
    last = F.greatest(F.ceil(F.octet_length(whole(text)) / F.lit(size)).cast("int") - 1, F.lit(0))
    cut = lambda raw: F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))
    return F.transform(F.array(whole(text).cast("binary")), cut)[0]


def address(block: Column, seed: int) -> Column:
    """128 bits of a block."""
    return F.struct(F.xxhash64(F.lit(seed), block).alias("high"), F.xxhash64(F.lit(seed + 1), block).alias("low"))


def _in_order(counted: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Distinct things and their counts, sorted where they were dealt to, and named by their places."""
    return counted.sortWithinPartitions(*by).select(*keys, "n", F.monotonically_increasing_id().alias("name"))


def named_blocks(docs: DataFrame, size: int, at: Callable[[Column], Column]) -> DataFrame:
    """high, low, n, name of each distinct block of the texts."""
    contents = docs.select(F.explode(blocks(size)).alias("block")).select(at(F.col("block")).alias("at"), "block")
    counted = contents.select("at.high", "at.low", "block").groupBy("high", "low", "block").agg(F.count("*").alias("n"))
    return written(_in_order(counted, ["high", "low"], ["block"]), "block-names")


def named_pairs(pairs: DataFrame) -> DataFrame:
    """left, right, n, name of each distinct pair."""
    counted = pairs.groupBy("left", "right").agg(F.count("*").alias("n"))
    return written(_in_order(counted, ["left", "right"], ["left", "right"]), "pair-names")


def paired(nodes: DataFrame) -> DataFrame:
    """Adjacent names of (row, nodes, pos, name), two by two."""
    side = lambda odd: F.max(F.when(F.col("pos").bitwiseAND(F.lit(1)) == odd, F.col("name")))
    both = nodes.groupBy("row", "nodes", F.shiftright("pos", 1).alias("pair")).agg(side(0).alias("left"), F.coalesce(side(1), F.lit(NO_NAME)).alias("right"))
    return both.select("row", F.shiftright(F.col("nodes") + 1, 1).alias("nodes"), F.col("pair").alias("pos"), "left", "right")


def identified(docs: DataFrame, row: Column | None = None, size: int = BLOCK, addressed: Callable[[Column, int], Column] = address) -> DataFrame:
    """row, doc_id, sha256 (binary), level, name of every row of ``docs`` (doc_id, text).

    Texts are equal if and only if level and name are. ``row`` is a unique long of each row, by default a number given here.
    """
    for seed in itertools.count(0, 2):
        at = lambda block, seed=seed: addressed(block, seed)
        parts = F.transform(blocks(size), lambda block: at(block))  # noqa: B023
        number = F.monotonically_increasing_id() if row is None else row
        texts = written(docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(whole(), 256)).alias("sha256"), parts.alias("parts")), "addressed")
        names = named_blocks(docs, size, at)
        if names.groupBy("high", "low").count().filter("count > 1").isEmpty():
            break
    places = texts.select("row", F.size("parts").alias("nodes"), F.posexplode("parts").alias("pos", "at")).select("row", "nodes", "pos", "at.high", "at.low")
    nodes = looked_up(places, names, ["high", "low"]).select("row", "nodes", "pos", "name")
    found = []
    for level in itertools.count():
        nodes = written(nodes, f"level-{level}")
        found.append(nodes.filter("nodes = 1").select("row", F.lit(level).alias("level"), "name"))
        several = nodes.filter("nodes > 1")
        if several.isEmpty():
            break
        pairs = written(paired(several), "pairs")
        nodes = looked_up(pairs, named_pairs(pairs), ["left", "right"]).select("row", "nodes", "pos", "name")
    return texts.select("row", "doc_id", "sha256").join(functools.reduce(DataFrame.unionByName, found), "row")


def grouped(docs: DataFrame, row: Column | None = None, size: int = BLOCK) -> DataFrame:
    """row, doc_id, sha256, keep (the doc_id and row that stays of those with this text), n (their number)."""
    rows = written(identified(docs, row, size), "identified")
    groups = rows.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("n"))
    return looked_up(rows, written(groups, "groups"), ["level", "name"])


def exact_duplicates(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text)."""
    kept = F.col("row") == F.col("keep.row")
    return grouped(docs, size=size).select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any other columns) that stay, whole."""
    rows, key = keyed(docs)
    gone = grouped(rows, F.col(key), size).filter(F.col("row") != F.col("keep.row")).select("row")
    return without_ids(rows, gone, key).drop(key)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))
