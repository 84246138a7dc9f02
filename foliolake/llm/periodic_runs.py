"""Periodic runs of words, by Baier grouping and Lyndon roots.

A run is a stretch that repeats with a smallest period and that no neighbouring
word extends. Every run holds a Lyndon root: a longest Lyndon word, for one of
two opposite orders of the words, whose length is the period. Both Lyndon arrays
come from phase one of Baier's suffix sorter: places are grouped by what stands
there, groups are taken from the highest to the lowest, and each place moves up
by how many members of the group have it as their nearest lower place to the
left. What a place's last group stands for is its longest Lyndon word. Each root
is then extended by longest common extensions, forwards and backwards.

A run of four periods holds each of its four-word stretches twice or more, so
before that, stretches that don't recur between recurring ones are cut away, in
time linear in the words; no run is lost by it (a test compares). Runs with
fewer periods are searched in the whole text.

Texts are rows of Arrow batches, with no shuffle. Words are stretches without
ASCII white space; null, empty and blank texts have none. Repeated rows stay, an
empty table gives an empty result, extra columns are dropped. Memory for a row
is in proportion to its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm.storage import table

#: A run has at least this many periods and this many words.
PERIODS = 4
LEAST = 6
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.struct([("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_GRAM = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def lyndon_lengths(codes: np.ndarray) -> list[int]:
    """The length of the longest Lyndon word that starts at each place of a text of integers; the text's end is lowest.

    ``order`` lists the places by group. A group is named by where it begins, so higher groups have higher names.
    """
    n = len(codes)
    sorting = np.argsort(codes, kind="stable")
    heads = np.flatnonzero(np.diff(codes[sorting], prepend=codes[sorting[:1]] - 1))
    ends = np.append(heads[1:], n)
    group_of = np.empty(n, np.int64)
    group_of[sorting] = np.repeat(heads, ends - heads)
    at = np.empty(n, np.int64)
    at[sorting] = np.arange(n)
    order, at, group = sorting.tolist(), at.tolist(), group_of.tolist()
    end = dict(zip(heads.tolist(), ends.tolist(), strict=True))
    width = dict.fromkeys(end, 1)
    lower = [-1] * n
    top = n
    while top:
        here = group[order[top - 1]]
        times: dict[int, int] = {}
        for i in sorted(order[here:top]):
            j = i - 1
            while j >= 0 and group[j] > here:
                j = lower[j]
            if j >= 0 and group[j] == here:
                j = lower[j]
            lower[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        by_times: dict[int, list[int]] = {}
        for j, count in times.items():
            by_times.setdefault(count, []).append(j)
        for count in sorted(by_times, reverse=True):
            grown = count * width[here]
            before: dict[int, int] = {}  # groups that lose places, and where they ended
            for j in by_times[count]:
                old = group[j]
                last = end[old] - 1
                before.setdefault(old, last + 1)
                k, other = at[j], order[last]
                order[k], at[other] = other, k
                order[last], at[j] = j, last
                end[old] = last
            for j in by_times[count]:
                group[j] = end[group[j]]
            for old, was in before.items():
                new = end[old]
                width[new] = width[old] + grown
                end[new] = was
        top = here
    return [width[g] for g in group]


def common_extension(raw: bytes, i: int, j: int, limit: int) -> int:
    """How many 4-byte names from i on equal those from j on, at most ``limit``: by doubling, then halving."""

    def equal(a: int, b: int) -> bool:
        return raw[4 * (i + a) : 4 * (i + b)] == raw[4 * (j + a) : 4 * (j + b)]

    known, reach = 0, min(8, limit)
    while known < limit and equal(known, reach):
        known, reach = reach, min(2 * reach, limit)
    while reach - known > 1:  # up to known they are equal, up to reach they aren't
        middle = (known + reach) // 2
        known, reach = (middle, reach) if equal(known, middle) else (known, middle)
    return known


def lyndon_runs(ids: np.ndarray, periods: int = PERIODS, least: int = LEAST) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text of integers.

    A run of ``periods`` periods has that many Lyndon roots less one in a row, so only chains of equal lengths are extended.
    """
    n = len(ids)
    if n < 2:
        return set()
    codes = np.unique(ids, return_inverse=True)[1].astype(np.int32)
    raw, backwards = codes.tobytes(), codes[::-1].tobytes()
    found: set[tuple[int, int, int]] = set()
    for ordered in (codes, codes.max() - codes):
        length = np.array(lyndon_lengths(ordered), np.int64)
        roots = np.arange(n)
        for k in range(1, periods - 1):
            after = roots + k * length[roots]
            roots, after = roots[after < n], after[after < n]
            roots = roots[(length[after] == length[roots]) & (codes[after] == codes[roots])]
        covered: dict[int, int] = {}  # by period: where the last extension ended
        for i, p in zip(roots.tolist(), length[roots].tolist(), strict=True):
            j = i + p
            if j < covered.get(p, 0):
                continue
            left = common_extension(backwards, n - i, n - j, i)
            right = common_extension(raw, i, j, n - j)
            covered[p] = j + right
            if left + p + right >= max(least, periods * p):
                found.add((i - left, left + p + right, p))
    return found


def stretches(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches (from, to) of a text that hold every run of at least 4 periods and 6 words whole.

    Such a run has each of its four-word stretches at least twice. Hashes that clash only keep more.
    """
    if len(ids) < LEAST:
        return
    grams = ids[: len(ids) - _GRAM + 1].astype(np.uint64)
    for k in range(1, _GRAM):
        grams = (grams * _MIX) ^ ids[k : len(ids) - _GRAM + 1 + k].astype(np.uint64)
    bits = max(8, int(8 * len(grams)).bit_length())
    places, part, left = np.arange(len(grams)), np.zeros(len(grams), np.int64), -1
    while len(places) and len(places) != left:
        left = len(places)
        slots = (((grams[places] + part.astype(np.uint64) * _MIX) * _MIX) >> np.uint64(64 - bits)).astype(np.int64)
        places = places[np.bincount(slots)[slots] > 1]
        part = np.cumsum(np.diff(places, prepend=-2) != 1) - 1
        long = np.bincount(part, minlength=1)[part] >= LEAST - _GRAM + 1
        places, part = places[long], part[long]
    if len(places):
        breaks = np.flatnonzero(np.diff(places) != 1)
        yield from zip(places[np.append(0, breaks + 1)].tolist(), (places[np.append(breaks, len(places) - 1)] + _GRAM).tolist(), strict=True)


def runs_of(ids: np.ndarray, periods: int = PERIODS, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text of integers, by start, then period."""
    parts = stretches(ids) if periods >= PERIODS and least >= LEAST else [(0, len(ids))]
    return sorted((a + start, length, period) for a, b in parts for start, length, period in lyndon_runs(ids[a:b], periods, least))


def collapsed(text: bytes, periods: int = PERIODS, least: int = LEAST) -> tuple[list[tuple[int, int, int]], bytes]:
    """The runs of a text's words, and the text with each run cut to its first period."""
    words = text.split()
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    runs = runs_of(ids, periods, least)
    if not runs:
        return runs, b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return runs, b" ".join([words[k] for k in np.flatnonzero(kept)])


def found_in(text: Column, periods: int = PERIODS, least: int = LEAST, digest: bool = False) -> Column:
    """A struct of a text's ``runs`` and ``collapsed``, the text with each run cut to its first period, or its SHA-256."""

    @F.arrow_udf(f"struct<runs:{RUNS},collapsed:string>")
    def found(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.cast(pa.large_binary()):
            runs, kept = collapsed(text.as_py() or b"", periods, least)
            out.append({"runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], "collapsed": hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace")})
        return pa.array(out, _FOUND)

    return found(text)


def repeated(text: Column, doc_id: Column) -> Column:
    """The text, or for a tenth of the ids (by their CRC) its words with all after some word repeated with a period, one space between."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n = F.size(words)
    first = (g % n).cast("int")
    period = (1 + F.floor((n - first) / (3 + g % 8))).cast("int")
    passage = F.array_repeat(F.slice(words, first + 1, period), F.ceil((n - first) / period).cast("int"))
    over = F.slice(F.concat(F.slice(words, F.lit(1), first), F.flatten(passage)), F.lit(1), n)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(over, " ")).otherwise(text)


def periodic_runs(docs: DataFrame, periods: int = PERIODS, least: int = LEAST, digest: bool = False) -> DataFrame:
    """doc_id, runs, collapsed of every row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", found_in(F.col("text"), periods, least, digest).alias("found")).select("doc_id", "found.runs", "found.collapsed")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(docs.withColumn("text", repeated(F.col("text"), F.col("doc_id"))), digest=True)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.select("doc_id", "runs", "collapsed", longest.alias("m"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("m.start")).alias("start"),
        F.col("m.length").alias("length"),
        (-F.col("m.period")).alias("period"),
        F.floor(1000 * F.col("m.length") / -F.col("m.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"),
    )
