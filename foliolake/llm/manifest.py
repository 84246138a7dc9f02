"""A Merkle manifest of a dataset, with a proof for every row, by cogrouped subtree exchange.

Every row is a leaf. The leaves of a source, in the order of their ids, form a
tree of which each node has 16 children; the sources' roots, in the order of
their names, form another such tree with the dataset's root.

The leaves of a tree are cut into superblocks of 4096, which are whole subtrees.
Going up, a superblock is reduced to its node by one group of at most 4096 rows;
those nodes are the leaves of the next round, until one is left of each source.
Going down, a superblock's nodes and the outer nodes that its proofs need (the
siblings of the nodes above it, a few kilobytes) are cogrouped by superblock in
``applyInPandas``, which reduces the subtree again, joins local and outer
siblings to a proof for each leaf, and folds the leaf up to the root, all at
once. The outer nodes come from the round above in the same way, so a row and
its path meet by equal keys of one row on each side: a source with a third of
all rows is many superblocks, and no group has more rows than a superblock.

Null fields are ``-``. Null ids come first in their source and null sources
first of all; rows that repeat an id are leaves of their own, ordered by their
digests. An empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from hashlib import sha256
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm.storage import filled, looked_up, restored, table, written
from foliolake.operators.ranking import ranked

FANOUT = 16
#: Levels of a superblock.
LEVELS = 3


class Shape(NamedTuple):
    """How many nodes become one, and how many levels a superblock has."""

    fanout: int = FANOUT
    levels: int = LEVELS

    @property
    def leaves(self) -> int:
        return self.fanout**self.levels


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A node of a tree: its tree, the tree's number of nodes in this round, its place among them, its digest (hex).
NODES = "tree long, size long, place long, digest string"
#: Siblings before and after, from the lowest level to the highest.
PATH = "array<struct<before:string,after:string>>"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

#: ``run`` lists the nodes that become one; a leaf's steps are the runs above it, in its source and then among the sources.
ORACLE_SQL = """
WITH RECURSIVE
field AS (
  SELECT row_number() OVER () AS id, doc_id, source, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         doc_id IS NOT NULL AND crc32 % 5 = 0 AS tampered
  FROM (SELECT *, -- CRC-32 of the decimal id, bit by bit
               xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                 lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS crc32
        FROM documents)),
digest AS (
  SELECT id, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN tampered THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS presented
  FROM field),
leaf AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM digest),
up AS (
  SELECT 0 AS level, source, place, leaf AS digest, count(*) OVER (PARTITION BY source) AS size FROM leaf
  UNION ALL
  SELECT level + 1, source, place // 16, sha256(string_agg(digest, '' ORDER BY place)), (any_value(size) + 15) // 16
  FROM up WHERE size > 1 GROUP BY level, source, place // 16),
top AS MATERIALIZED (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM up WHERE size = 1),
high AS (
  SELECT 0 AS level, place, subroot AS digest, count(*) OVER () AS size FROM top
  UNION ALL
  SELECT level + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place)), (any_value(size) + 15) // 16
  FROM high WHERE size > 1 GROUP BY level, place // 16),
run AS MATERIALIZED (
  SELECT source, level, place // 16 AS run, list(digest ORDER BY place) AS nodes, false AS high FROM up WHERE size > 1 GROUP BY ALL
  UNION ALL
  SELECT NULL, level, place // 16, list(digest ORDER BY place), true FROM high WHERE size > 1 GROUP BY ALL),
place AS MATERIALIZED (
  SELECT id, l.source, l.place, false AS high FROM leaf l
  UNION ALL SELECT l.id, NULL, t.place, true FROM leaf l JOIN top t ON t.source IS NOT DISTINCT FROM l.source),
step AS MATERIALIZED (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY p.high, level) AS step, (p.place >> (4 * level)) % 16 AS spot, nodes
  FROM place p JOIN run r ON r.high = p.high AND r.source IS NOT DISTINCT FROM p.source AND r.run = p.place >> (4 * level + 4)),
side AS MATERIALIZED (SELECT id, step, array_to_string(nodes[:spot], '') AS before, array_to_string(nodes[spot + 2:], '') AS after FROM step),
proof AS (SELECT id, string_agg(before || after, '' ORDER BY step) AS nodes FROM side GROUP BY id),
fold AS (
  SELECT id, 1 AS step, coalesce(presented, leaf) AS digest FROM leaf
  UNION ALL
  SELECT id, step + 1, sha256(before || digest || after) FROM fold JOIN side USING (id, step)),
folded AS (SELECT id, arg_max(digest, step) AS folded_root FROM fold GROUP BY id),
root AS (SELECT digest AS root FROM high WHERE size = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(nodes, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaf JOIN top ON top.source IS NOT DISTINCT FROM leaf.source JOIN folded USING (id) LEFT JOIN proof USING (id) CROSS JOIN root
"""


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """The digest of a row (doc_id, source, lang, n_chars) with a text."""
    return F.sha2(F.concat(*[_field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)]), 256)


def digest_of(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def levels_of(nodes: list[str], size: int, shape: Shape) -> list[list[str]]:
    """The nodes of a superblock of a tree, level by level: up to one node in the tree's last round, else up to the superblock's height."""
    levels = [nodes]
    while len(levels[-1]) > 1 or (size > shape.leaves and len(levels) <= shape.levels):
        below = levels[-1]
        levels.append([digest_of(below[k : k + shape.fanout]) for k in range(0, len(below), shape.fanout)])
    return levels


def siblings(levels: list[list[str]], place: int, fanout: int) -> list[dict[str, str]]:
    """What stands before and after the node at a place, and before and after each node above it."""
    path = []
    for nodes in levels[:-1]:
        first = place // fanout * fanout
        path.append({"before": "".join(nodes[first:place]), "after": "".join(nodes[place + 1 : first + fanout])})
        place //= fanout
    return path


def folded(digest: str, path: list[dict[str, str]]) -> str:
    """The root that a node and its siblings give."""
    for step in path:
        digest = sha256(f"{step['before']}{digest}{step['after']}".encode()).hexdigest()
    return digest


def _superblock(shape: Shape) -> Column:
    return F.floor(F.col("place") / shape.leaves).alias("superblock")


def reduced(nodes: DataFrame, shape: Shape) -> DataFrame:
    """The next round: a node for each superblock of each tree."""

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = int(rows["size"].iloc[0])
        top = levels_of(rows.sort_values("place")["digest"].tolist(), size, shape)[-1][0]
        return pd.DataFrame([(key[0], -(-size // shape.leaves), key[1], top)], columns=["tree", "size", "place", "digest"])

    return nodes.select("tree", "size", "place", "digest").groupBy("tree", _superblock(shape)).applyInPandas(reduce, NODES)


def rounds(leaves: DataFrame, shape: Shape) -> list[DataFrame]:
    """Nodes of trees (tree, size, place, digest), written: the leaves given, then a round after the other up to one node of each tree."""
    found = [leaves]
    while len(found) == 1 or not found[-1].filter("size > 1").isEmpty():
        found.append(written(reduced(found[-1], shape), "nodes"))
    return found


def _cogrouped(nodes: DataFrame, outer: DataFrame, shape: Shape):
    return nodes.groupBy("tree", _superblock(shape)).cogroup(outer.groupBy("tree", F.col("place").alias("superblock")))


def paths(nodes: DataFrame, outer: DataFrame, shape: Shape) -> DataFrame:
    """tree, place, path of each node, of the paths of the superblocks (tree, place, path)."""

    def descend(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        levels = levels_of(rows["digest"].tolist(), int(rows["size"].iloc[0]), shape)
        outside = [dict(step) for step in above["path"].iloc[0]]
        found = [(key[0], place, siblings(levels, k, shape.fanout) + outside) for k, place in enumerate(rows["place"].tolist())]
        return pd.DataFrame(found, columns=["tree", "place", "path"])

    return _cogrouped(nodes.select("tree", "size", "place", "digest"), outer, shape).applyInPandas(descend, f"tree long, place long, path {PATH}")


def proofs(leaves: DataFrame, outer: DataFrame, shape: Shape) -> DataFrame:
    """Every leaf (doc_id, presented beside a node's columns) with its proof and what it folds to; ``outer``: tree, place, subroot, root, path."""

    def finish(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        nodes = rows["digest"].tolist()
        levels = levels_of(nodes, int(rows["size"].iloc[0]), shape)
        outside = [dict(step) for step in above["path"].iloc[0]]
        subroot, root = above["subroot"].iloc[0], above["root"].iloc[0]
        out = []
        for k, (doc_id, presented) in enumerate(zip(rows["doc_id"].tolist(), rows["presented"].tolist(), strict=True)):
            if k % shape.fanout == 0:
                higher = (siblings(levels[1:], k // shape.fanout, shape.fanout) if len(levels) > 1 else []) + outside
                tail = "".join(step["before"] + step["after"] for step in higher)
            own = siblings(levels[:2], k, shape.fanout)
            proof = sha256(("".join(step["before"] + step["after"] for step in own) + tail).encode()).hexdigest()
            end = folded(presented if isinstance(presented, str) else nodes[k], own + higher)
            out.append((doc_id, nodes[k], subroot, root, proof, end, end == root))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PROOFS.split(", ")], dtype=object)

    return _cogrouped(leaves.select("tree", "size", "place", "digest", "doc_id", "presented"), outer, shape).applyInPandas(finish, PROOFS)


def placed_leaves(docs: DataFrame, presented: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The leaves with their trees and places, and the sources: source, no_source, n, tree; both written."""
    given = F.lit(None).cast("string") if presented is None else presented
    digests = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(F.col("text")).alias("digest"), given.alias("presented"))
    found = ranked(written(digests, "leaves"), ["source", "doc_id", "digest"])
    found = found.withColumns({"no_source": F.col("source").isNull(), "source": F.coalesce("source", F.lit(""))})
    counted = written(found.groupBy("source", "no_source").agg(F.min("rank").alias("first"), F.count("*").alias("n")), "sources")
    sources = written(ranked(counted, ["first"]).withColumnRenamed("rank", "tree"), "trees")
    leaves = looked_up(found, sources, ["source", "no_source"])
    return written(leaves.select("tree", F.col("n").alias("size"), (F.col("rank") - F.col("first")).alias("place"), "digest", filled(), "presented"), "placed"), sources


def source_roots(leaf_rounds: list[DataFrame], sources: DataFrame, shape: Shape) -> tuple[DataFrame, list[DataFrame]]:
    """The sources' roots as leaves of the dataset's tree (place is the source's tree), and that tree's rounds."""
    size = sources.count()
    top = leaf_rounds[-1].select(F.lit(0).cast("long").alias("tree"), F.lit(size).cast("long").alias("size"), F.col("tree").alias("place"), "digest")
    top = written(top, "roots")
    return top, rounds(top, shape)


def roots(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """source, n, subroot, root of each source: what a manifest publishes."""
    leaves, sources = placed_leaves(docs)
    top, above = source_roots(rounds(leaves, shape), sources, shape)
    named = sources.select("tree", F.when(~F.col("no_source"), F.col("source")).alias("source"), "n")
    both = named.join(top.select(F.col("place").alias("tree"), F.col("digest").alias("subroot")), "tree")
    return both.crossJoin(F.broadcast(above[-1].select(F.col("digest").alias("root")))).select("source", "n", "subroot", "root")


def verified_manifest(docs: DataFrame, presented: Column | None = None, shape: Shape = Shape()) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    ``presented`` is the digest of the row as it is now, where that may differ (else null): it is folded with the siblings of the original.
    """
    leaves, sources = placed_leaves(docs, presented)
    up = rounds(leaves, shape)
    top, above = source_roots(up, sources, shape)
    outer = above[-1].select("tree", "place", F.array().cast(PATH).alias("path"))
    for nodes in reversed(above[:-1]):
        outer = written(paths(nodes, outer, shape), "paths")
    root = F.broadcast(above[-1].select(F.col("digest").alias("root")))  # one row
    subroots = top.select("place", F.col("digest").alias("subroot")).crossJoin(root)
    outer = outer.select("place", "path").join(subroots, "place")
    ends = outer.select(F.col("place").alias("tree"), "subroot", "root")
    outer = outer.select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), "subroot", "root", "path")
    for nodes in reversed(up[1:-1]):
        outer = written(paths(nodes, outer.select("tree", "place", "path"), shape), "paths").join(ends, "tree")
    found = proofs(up[0], outer, shape)
    return found.withColumn("doc_id", restored())


def tampered(every: int = 5) -> Column:
    """The digest of a row whose text lost its capitals, for the rows that the ids' CRC chooses; else null."""
    lowered = F.translate("text", _UPPER, _UPPER.lower())
    return F.when(F.crc32(F.col("doc_id").cast("string")) % every == 0, leaf_digest(lowered))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(table(spark, sf_dir, "documents"), tampered())
