from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from foliolake.llm import manifest
from foliolake.llm.queries import ORACLE_SQL


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(nodes: list[str], fanout: int) -> tuple[str, list[list[tuple[list, list]]]]:
    """The root, and for each leaf its siblings before and after, level by level."""
    paths: list[list] = [[] for _ in nodes]
    under = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        for k, leaves in enumerate(under):
            first = k // fanout * fanout
            for x in leaves:
                paths[x].append((nodes[first:k], nodes[k + 1 : first + fanout]))
        under = [sum(under[k : k + fanout], []) for k in range(0, len(nodes), fanout)]
        nodes = [sha("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute(rows: list, fanout: int = 16) -> list[tuple]:
    by_source: dict = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subroots, own = [], []
    for name in names:
        ordered = sorted(by_source[name], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        subroot, paths = tree([leaf(r, r.text) for r in ordered], fanout)
        subroots.append(subroot)
        own.append(list(zip(ordered, paths, strict=True)))
    root, tops = tree(subroots, fanout)
    out = []
    for subroot, top, members in zip(subroots, tops, own, strict=True):
        for r, path in members:
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            digest = leaf(r, lower(r.text) if changed else r.text)
            for before, after in path + top:
                digest = sha("".join([*before, digest, *after]))
            out.append((r.doc_id, leaf(r, r.text), subroot, root, sha("".join("".join(b + a) for b, a in path + top)), digest, digest == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(docs, shape=manifest.Shape()) -> list[tuple]:
    rows = manifest.verified_manifest(docs, manifest.tampered(), shape)
    assert rows.columns == COLUMNS
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def test_query_equals_sql(spark, tiny, against_sql):
    against_sql(spark, manifest.op12_merkle_manifest, ORACLE_SQL["op12_merkle_manifest"], tiny)


def test_odd_rows_equal_brute_force_and_sql(spark, odd, empty, tmp_path, against_sql):
    assert found(odd) == sorted(brute(odd.collect()), key=repr)
    assert found(empty) == []
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    against_sql(spark, manifest.op12_merkle_manifest, ORACLE_SQL["op12_merkle_manifest"], str(tmp_path))


@pytest.mark.parametrize("fanout, levels", [(2, 2), (3, 1)])
def test_trees_of_many_rounds_equal_brute_force(spark, fanout, levels):
    """With small superblocks, a hot source and many sources take several rounds."""
    ids = spark.range(61)
    docs = ids.select(F.col("id").alias("doc_id"), F.when(F.col("id") < 27, F.lit("hot")).when(F.col("id") % 17 > 0, F.concat(F.lit("s"), F.col("id") % 17)).alias("source"), F.lit("en").alias("lang"), F.lit(3).cast("long").alias("n_chars"), F.concat(F.lit("Text "), "id").alias("text"))
    docs = docs.cache()
    assert found(docs, manifest.Shape(fanout, levels)) == sorted(brute(docs.collect(), fanout), key=repr)


def test_one_row_and_roots(spark, odd):
    one = odd.filter("doc_id = 1")
    row = manifest.verified_manifest(one).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == sha("")
    published = {r.source: (r.n, r.subroot, r.root) for r in manifest.roots(odd).collect()}
    expected = brute(odd.collect())
    sources = {leaf(r, r.text): r.source for r in odd.collect()}
    assert {sources[x[1]]: x[2:4] for x in expected} == {s: (sub, root) for s, (_, sub, root) in published.items()}
    assert sum(n for n, _, _ in published.values()) == odd.count()


def test_what_a_changed_row_folds_to(spark, tiny):
    rows = manifest.op12_merkle_manifest(spark, tiny)
    assert rows.filter(F.col("verified") != (F.col("folded_root") == F.col("root"))).isEmpty()
    changed = rows.filter("not verified").select("doc_id").collect()
    assert changed and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in changed)
