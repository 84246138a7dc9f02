"""Token counts, token files and packing."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliolake.llm import bpe, packing, token_counts, token_store
from foliolake.llm.storage import table, written


@pytest.fixture(scope="module")
def texts(spark, tiny):
    return {r.doc_id: r.text or "" for r in table(spark, tiny, "documents").collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))


def test_counts_equal_the_library(spark, tiny, texts, library):
    rows = token_counts.op7_token_counts(spark, tiny).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_counts_of_odd_rows(odd, empty):
    rows = token_counts.token_counts(odd).collect()
    assert len(rows) == odd.count()
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2)] == [0, 0]
    assert token_counts.token_counts(empty).count() == 0


def test_token_files_round_trip(spark, tiny, texts, library):
    rows = token_store.op10_token_files(spark, tiny).collect()
    start, by_id = 0, {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    for doc_id in sorted(texts):
        ids = np.array([*library.encode(texts[doc_id], add_special_tokens=False).ids, 0], dtype="<u4")
        r = by_id[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def _round_trip(docs, folder, **limits):
    return sorted(token_store.read_token_files(token_store.write_token_files(docs, str(folder), **limits)).collect(), key=lambda r: r.start)


def test_token_files_of_odd_rows(odd, empty, tmp_path):
    rows = _round_trip(odd, tmp_path, ids_per_file=500)
    assert [r.doc_id is None for r in rows[:2]] == [True, True]
    assert [r.doc_id for r in rows[2:]] == [1, 2, 3, 4, 4, 5, 6, 2**60 + 1]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert _round_trip(empty, tmp_path) == []


def test_one_id_is_spread_over_ranges(spark, tmp_path):
    docs = spark.range(3000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t "), F.col("id")).alias("text"))
    manifest = token_store.write_token_files(docs.repartition(3), str(tmp_path), docs_per_range=300).collect()
    assert sum(r.documents for r in manifest) == 3000 and max(r.documents for r in manifest) < 1200
    assert {int(k) for r in manifest for k in token_store.TokenFile(r.path).doc_ids} >= {1, 7, 2999}


def test_files_that_the_manifest_does_not_name_are_not_read(spark, odd, tmp_path):
    manifest = token_store.write_token_files(odd, str(tmp_path))
    stray = token_store.TokenFileWriter(f"{tmp_path}/part-000000-0000-{'0' * 32}.flef", 2)
    stray.add(99, np.array([1, 2, 3]))
    stray.close()
    assert token_store.read_token_files(manifest).count() == odd.count()
    (tmp_path / "cut.flef").write_bytes((tmp_path / stray.path.rpartition("/")[2]).read_bytes()[:-1])
    with pytest.raises(ValueError):
        token_store.TokenFile(f"{tmp_path}/cut.flef")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano_selects_every_value(gaps):
    values = np.cumsum(gaps).astype(np.int64)
    coded = token_store.EliasFano.of(values)
    assert [coded[k] for k in range(len(values))] == values.tolist()


def test_files_are_read_by_select_and_are_small(tmp_path):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 3000, 1000).tolist()
    ids = rng.integers(0, 50_000, sum(lengths)).astype(np.uint32)
    ends = np.cumsum(lengths)
    out = token_store.TokenFileWriter(f"{tmp_path}/deep/a.flef", 2)
    for k, (a, b) in enumerate(zip(ends - lengths, ends, strict=True)):
        out.add(k - 5, ids[a:b])
    out.close()
    file = token_store.TokenFile(f"file:{tmp_path}/deep/a.flef")
    assert file.doc_ids.tolist() == list(range(-5, 995)) and file.n_ids == len(ids)
    for k in (999, 0, 500, 501, 3):
        assert file.bounds(k) == (ends[k] - lengths[k], ends[k]) and np.array_equal(file.ids(k), ids[ends[k] - lengths[k] : ends[k]])
    size = (tmp_path / "deep" / "a.flef").stat().st_size
    assert size - 2 * len(ids) - 8 * 1000 < 2.5 * 1000  # near 2 + log2(mean length) bits a boundary


def _check_packing(rows, expected: dict) -> None:
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert set(pieces) == set(expected)
    for doc_id, ids in expected.items():
        start = 0
        for n, (piece, begin, length, crc) in enumerate(sorted(pieces[doc_id])):
            assert (piece, begin) == (n, start)
            assert crc == zlib.crc32(np.array(ids[begin : begin + length], dtype="<u4").tobytes())
            assert n == 0 or length == packing.CAPACITY
            start += length
        assert start == len(ids)
    least = -(-sum(map(len, expected.values())) // packing.CAPACITY)
    assert len(sequences) <= 1.05 * least + 2


def test_packing_is_whole_gapless_and_tight(spark, tiny, texts, library):
    _check_packing(packing.op3_best_fit_packing(spark, tiny).collect(), {d: [*library.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()})


def test_the_bound_closes_sequences_on_the_tables(spark, tiny, texts):
    """With few sequences open at a time some close early; the result is whole all the same, and no looser than it must be."""
    lengths = sorted((p[2] for ids in bpe.encoder().encode_all(iter(texts.values()), 2) for p in packing.pieces_of(ids)), reverse=True)
    bins = packing.OpenSequences(packing.CAPACITY, 20)
    sequences, _, used = packing.best_fit(lengths, most=20, bins=bins)
    assert bins.closed > 0 and bins.count <= 20 and used == len(set(sequences))
    free = packing.OpenSequences(packing.CAPACITY, packing.OPEN_SEQUENCES)
    assert packing.best_fit(lengths, bins=free)[2] <= used and free.closed == 0


def test_rows_that_share_an_id_are_dealt_to_all_tasks(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    pieces = written(packing.tokenized_pieces(docs), "pieces")
    placed = packing.pack(pieces, per_task=500)
    sizes = [r.n for r in placed.groupBy(F.shiftright("sequence_id", 40).alias("task")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4000 and len(sizes) == 8 and max(sizes) < 1500


def test_packing_of_odd_rows(odd, empty):
    rows = packing.pack_documents(odd).collect()
    assert sum(r.doc_id is None for r in rows) == 2
    assert [(r.length, r.piece) for r in rows if r.doc_id in (1, 2)] == [(1, 0), (1, 0)]
    assert packing.pack_documents(empty).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 1024), max_size=300), st.integers(1, 40))
def test_bounded_best_fit_never_overflows(lengths, most):
    sequences, offsets, used = packing.best_fit(lengths, most=most)
    filled = defaultdict(int)
    for length, sequence, offset in zip(lengths, sequences, offsets, strict=True):
        assert filled[sequence] == offset
        filled[sequence] += length
    assert max(filled.values(), default=0) <= 1024 and len(filled) == used


def test_fullest_open_sequence_closes_first():
    # 900 and 500 fill two sequences; with two open, 600 opens a third and closes the one with 900
    sequences, offsets, _ = packing.best_fit([900, 500, 600, 100], most=2)
    assert sequences == [0, 1, 2, 2] and offsets == [0, 0, 0, 600]
