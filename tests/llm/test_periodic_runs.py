from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from foliolake.llm import periodic_runs
from foliolake.llm.storage import table


def brute_runs(words: list, periods: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """All runs, by every period."""
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.array([names[w] for w in words], dtype=np.int64)
    out = []
    for p in range(1, len(ids) // periods + 1):
        same = np.concatenate(([False], ids[p:] == ids[:-p], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            length = b - a + p
            s = ids[a : a + length]
            if length >= max(least, periods * p) and not any(p % q == 0 and (s[q:] == s[:-q]).all() for q in range(1, p)):
                out.append((a, length, p))
    return sorted(out)


def brute_row(doc_id, text) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(((length, -s, -p) for s, length, p in runs), default=None)
    start, length, period = (-best[1], best[0], -best[2]) if best else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(runs), start, length, period, 1000 * length // period if best else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, tiny):
    expected = sorted(brute_row(r.doc_id, r.text) for r in table(spark, tiny, "documents").collect())
    found = periodic_runs.op13_periodic_runs(spark, tiny)
    assert found.columns == COLUMNS
    assert sorted(tuple(r) for r in found.collect()) == expected
    assert sum(1 for r in expected if r[1]) >= 10


def test_odd_and_planted_rows_equal_brute_force(spark, odd, empty, tmp_path):
    planted = [(i, f"start {'round and round ' * (i % 9)}end" + " x" * (i % 7), None, None) for i in range(100, 400)]
    rows = odd.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(planted, "doc_id long, text string, lang string, source string"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    found = periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect()
    cheap = [r for r in rows.collect() if len(r.text or "") < 50_000]
    assert len(found) == rows.count()
    got = sorted((tuple(r) for r in found), key=repr)
    assert all(brute_row(r.doc_id, r.text) in got for r in cheap)
    assert [(r.n_runs, r.start, r.length, r.period) for r in found if r.doc_id == 4] == [(1, 0, 28000, 7)] * 2
    assert periodic_runs.periodic_runs(empty).count() == 0


def lyndon(s: list[int]) -> list[int]:
    ends = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        ends.append(j - i)
    return ends


def strings(count: int, seed: int):
    rng = random.Random(seed)
    for _ in range(count):
        s = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.5:
            s = s[:5] + s[: rng.randint(1, 6)] * rng.randint(2, 9) + s[5:]
        yield s


def test_phase_one_gives_the_lyndon_array_for_both_orders():
    for s in strings(1000, 1):
        a = np.array(s)
        assert periodic_runs.lyndon_lengths(a) == lyndon(s)
        assert periodic_runs.lyndon_lengths(a.max() - a) == lyndon([max(s) - x for x in s])


def test_runs_of_any_exponent_equal_brute_force():
    for s in strings(600, 2):
        for periods, least in ((2, 2), (3, 3), (4, 6)):
            assert periodic_runs.runs_of(np.array(s), periods, least) == brute_runs(s, periods, least)


def test_no_run_is_cut_away():
    for s in strings(600, 3):
        ids = np.array(s)
        assert periodic_runs.runs_of(ids) == sorted(periodic_runs.lyndon_runs(ids))


def test_time_is_nearly_linear():
    n = 200_000
    for ids in (np.zeros(n, int), np.arange(n)[::-1].copy(), np.tile(np.arange(n // 5), 5), np.arange(n) % 2, np.random.default_rng(1).integers(0, 2, n)):
        began = time.process_time()
        periodic_runs.lyndon_runs(ids)
        assert time.process_time() - began < 30


def test_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "a b b b b b b c"), (2, "no run here")], "doc_id long, text string")
    rows = {r.doc_id: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert rows[1].collapsed == "a b c" and [tuple(x) for x in rows[1].runs] == [(1, 6, 1)]
    assert rows[2].collapsed == "no run here" and rows[2].runs == []
    assert docs.select(periodic_runs.found_in(F.col("text"), 2, 2).alias("f")).filter("size(f.runs) = 1").count() == 1
