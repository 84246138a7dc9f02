from __future__ import annotations

import itertools
import random

import xxhash

from foliolake.llm import simhash
from foliolake.llm.storage import table, written


def brute_fingerprint(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints: list[tuple[int, int]]) -> dict[int, int]:
    """doc_id -> smallest doc_id reachable, over all pairs."""
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, p), (b, q) in itertools.combinations(prints, 2):
        if (p ^ q).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d, _ in prints}


def test_query_equals_brute_force(spark, tiny):
    texts = {r.doc_id: r.text for r in table(spark, tiny, "documents").collect()}
    prints = [(d, brute_fingerprint(t)) for d, t in texts.items()]
    expected = brute_components(prints)
    rows = simhash.op2_simhash_near_dedup(spark, tiny).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{p:016x}", expected[d]) for d, p in prints}


def test_masks_cover_every_pair_of_positions():
    masks = simhash.covering_masks()
    for i, j in itertools.combinations_with_replacement(range(64), 2):
        assert any(not (m >> i & 1) and not (m >> j & 1) for m in masks)


def test_components_with_hot_buckets_equal_brute_force(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    near = [centre ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(0, 64, 4), 2)]
    chain = [rng.getrandbits(64)]
    for _ in range(30):
        chain.append(chain[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints = list(enumerate([*near, *chain, *[rng.getrandbits(64) for _ in range(40)], centre, centre, 0, 0]))
    rng.shuffle(prints)
    signed = [(d, p - (1 << 64) if p >> 63 else p) for d, p in prints]
    found = simhash.components(written(spark.createDataFrame(signed, "doc_id long, fp long"), "prints")).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_components(prints)


def test_every_link_of_small_and_full_buckets_is_found(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(63)
    fps = sorted({centre, *(centre ^ (1 << a) for a in range(60)), *(centre ^ (1 << a) ^ (1 << (a + 1)) for a in range(60))})
    frame = written(spark.createDataFrame([(p,) for p in fps], "fp long"), "fps")
    links = {(r.a, r.b) for r in simhash.candidate_links(frame, small_bucket=10_000).collect()}
    assert links == {(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2}
    linked = simhash.connected_components(simhash.candidate_links(frame, small_bucket=2)).collect()
    assert {r.b for r in linked} == set(fps[1:]) and {r.a for r in linked} == {fps[0]}


def test_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    blank = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(blank) == 4 and {r.component_id for r in blank} == {1}
    assert simhash.near_duplicates(empty).count() == 0
