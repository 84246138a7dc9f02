"""SimHash near-duplicate groups by covering locality-sensitive hashing.

A text's fingerprint has a bit set if over half of its shingles' XXH64 hashes
have it set. Fingerprints that differ in at most 2 of 64 bits are linked.

Each bit position gets a non-zero vector of 3 bits; table v (of the 7 non-zero
vectors) masks the positions whose vector has an odd product with v. For any two
positions some v is orthogonal to both, so two fingerprints that differ in at
most 2 bits agree in the masked bits of at least one table: no pair is missed.
A table's key has 36 or 37 bits.

Equal fingerprints are one row from the start, so thousands of copies cost
nothing. Rows with an equal key are compared within buckets of up to
``SMALL_BUCKET``. A fuller bucket is never paired: each of its fingerprints is
listed under itself and under each fingerprint that differs in one unmasked bit.
Two fingerprints differ in at most 2 bits if and only if they share such a
midpoint, and no midpoint has over 65 fingerprints. Components follow by
alternating large-star and small-star steps, each written to the shared folder.

Null and empty texts have fingerprint zero and link like any other. Repeated
rows stay. Rows with a null doc_id are returned with a component_id that counts
non-null ids only. An empty table gives an empty result. Extra columns are
dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm.storage import plain, table, written

BITS = 64
SEED = 42
SMALL_BUCKET = 32
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ROWS = 1 << 15


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(words_per_shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    spans = list(zip(starts, ends[k - 1 :].tolist(), strict=True))
    for at in range(0, len(spans), _ROWS):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans[at : at + _ROWS]], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(spans)))


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, ids: Column | None = None) -> DataFrame:
    """doc_id (or ``ids`` in its place) and fp, the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def signed(texts: pa.Array) -> pa.Array:
        values = np.fromiter((fingerprint(t, words_per_shingle) for t in plain(texts)), np.uint64, len(texts))
        return pa.array(values.view(np.int64))

    ids = F.col("doc_id").cast("long") if ids is None else ids
    return docs.select(ids.alias("doc_id"), signed("text").alias("fp"))


def covering_masks() -> list[int]:
    """The 7 masks, as signed longs: any two positions are both outside at least one."""
    vectors = [1 + i % 7 for i in range(BITS)]
    masks = [sum(1 << i for i, vector in enumerate(vectors) if (vector & v).bit_count() % 2) for v in range(1, 8)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _bit(b: int) -> int:
    return -(1 << 63) if b == 63 else 1 << b


def candidate_links(fps: DataFrame, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in 1 or 2 bits.

    All pairs of small buckets; of fuller buckets, for each midpoint, its least
    fingerprint with each other one, which connects the same components.
    """
    masks = covering_masks()
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)]))
    keyed = fps.select("fp", keys.alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    sized = written(keyed.join(sizes, ["t", "key"]), "buckets")

    differ = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= 2
    near = lambda x: F.transform(F.filter("fps", lambda y: (y > x) & differ(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))
    small = sized.filter(F.col("n") <= small_bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    pairs = small.select(F.explode(F.flatten(F.transform("fps", near))).alias("p")).select("p.a", "p.b")

    flips = [F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_bit(b))) for b in range(BITS) if not m >> b & 1]) for m in masks]
    of_table: Column = flips[0]
    for t in range(1, len(masks)):
        of_table = F.when(F.col("t") == t, flips[t]).otherwise(of_table)
    midpoints = sized.filter(F.col("n") > small_bucket).select("fp", F.explode(of_table).alias("mid"))
    around = midpoints.groupBy("mid").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = around.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b")
    return pairs.unionByName(stars).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """Stars (a, b): each vertex b with an edge and the least vertex a of its component, a < b."""
    edges = written(edges.select("a", "b").filter("a <> b"), "edges")
    state = None
    while True:
        both = _both_ways(edges)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        large = written(large, "large-star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b")
        edges = written(small.unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct(), "small-star")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return edges
        state = seen


def components(prints: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for rows (doc_id, fp); ``prints`` is read twice, so pass a written table."""
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    stars = connected_components(candidate_links(fps))
    rooted = fps.join(stars.select(F.col("b").alias("fp"), F.col("a").alias("root")), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    # only components of several fingerprints need the join; the others are their own
    several = rooted.join(stars.select(F.col("a").alias("root")).distinct(), "root", "left_semi").groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(several, "root", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs`` (doc_id, text)."""
    found = components(written(fingerprints(docs), "prints"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def copies(docs: DataFrame, key: str) -> DataFrame:
    """``key`` (unique) of every row of ``docs`` but the first of each component.

    The order is by doc_id, nulls last, then the text's digest, so that the same
    text stays however the rows are dealt, then key.
    """
    order = F.struct(F.col("doc_id").isNull().alias("without_id"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), F.col(key).alias("key"))
    found = components(written(fingerprints(docs, ids=order), "prints"))
    return found.filter(F.col("doc_id.key") != F.col("component_id.key")).select(F.col("doc_id.key").alias(key))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
