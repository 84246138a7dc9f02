"""Benchmark decontamination by a positional inverted index.

Index. Each batch of documents is a segment with its own positional postings:
one row for each (segment, term), with the term's places in the segment's word
stream, delta-coded. Documents follow each other in the stream, each with its
first place and its length. The index is a Parquet table in the shared folder;
building it needs no shuffle.

Search. Items are cut into phrases (windows). A phrase's rarest term in the whole
index says which segments to look at: an item's words are sent once to each
segment that holds the rarest term of one of its phrases, and meet there the
postings of the items' terms. In a segment the postings of a phrase are
intersected, shifted by their offsets, from its rarest term there on, until no
place is left. What a segment gets is bounded by its documents and by the items
that may occur in it, each once; neither a frequent word nor a passage that many
documents share gathers in one task.

A phrase occurs at a base place b of a document if each of its terms stands there
at most ``slack`` places from b plus its offset, inside the document. Words are
hit where such a term stands. A slack of 0 asks for the exact phrase.

Terms are XXH64 hashes of words, so "exact" is up to their collisions. Words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Null and empty
texts have no words and no hits; items without words have no window. Rows that
repeat an item_id are one item; items without an id are one item too, which
counts but has no id to list. Rows that repeat a doc_id are searched and returned
each. Empty tables give an empty result or one without hits. Extra columns are
dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm.storage import BROADCAST_IDS, filled, restored, small_side, table, written

WINDOW = 10
#: Upper case becomes lower case; what is no part of a word becomes a space.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Words of a segment, at most (and one document).
SEGMENT_WORDS = 1_000_000

INDEX = "segment long, term long, n long, places binary, doc_ids binary, firsts binary, lengths binary"
HITS = "doc_id long, n_words long, n_hit long, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


def term_of(word: bytes) -> int:
    """A word's term, as a signed long."""
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def _segment(segment: int, doc_ids: list, streams: list[np.ndarray], vocabulary: dict[bytes, int]) -> pa.RecordBatch:
    """The index rows of one segment: one for each term, and one, without a term, for the documents."""
    lengths = np.array([len(s) for s in streams], dtype=np.int64)
    firsts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(lengths) else lengths
    ids = np.concatenate(streams)
    at = (np.arange(len(ids), dtype=np.int64) + np.repeat(np.arange(len(lengths)), lengths)).astype(np.uint32)
    order = np.argsort(ids, kind="stable")
    counts = np.bincount(ids, minlength=len(vocabulary))
    places = at[order]
    deltas = np.diff(places, prepend=np.uint32(0))
    heads = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    if len(ids):
        deltas[heads] = places[heads]
    ends = np.concatenate(([0], np.cumsum(counts), [counts.sum()])).astype(np.int32) * 4
    n = len(vocabulary) + 1
    postings = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(deltas.astype("<u4"))])
    only_last = lambda raw: pa.array([None] * (n - 1) + [raw], pa.binary())
    terms = pa.array([*(term_of(w) for w in vocabulary), None], pa.int64())
    columns = [pa.array(np.full(n, segment)), terms, pa.array(np.append(counts, 0).astype(np.int64)), postings]
    columns += [only_last(np.array(doc_ids, dtype="<i8").tobytes()), only_last(firsts.astype("<i8").tobytes()), only_last(lengths.astype("<i8").tobytes())]
    return pa.RecordBatch.from_arrays(columns, names=["segment", "term", "n", "places", "doc_ids", "firsts", "lengths"])


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The positional index of ``docs`` (doc_id, text), written to the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        doc_ids: list[int] = []
        streams: list[np.ndarray] = []
        vocabulary: dict[bytes, int] = {}
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                streams.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)))
                doc_ids.append(doc_id)
                held += len(words) + 1
                if held >= segment_words:
                    yield _segment(segment, doc_ids, streams, vocabulary)
                    segment, doc_ids, streams, vocabulary, held = segment + 1, [], [], {}, 0
        if doc_ids:
            yield _segment(segment, doc_ids, streams, vocabulary)

    return written(docs.select(filled(), "text").mapInArrow(build, INDEX), "term-index")


def item_terms(items: DataFrame) -> DataFrame:
    """number, item, terms of every row of ``items`` (item_id, text) that has words, written; numbers are unique."""

    @F.arrow_udf("array<long>")
    def terms(texts: pa.Array) -> pa.Array:
        return pa.array([[term_of(w) for w in words_of(t.as_py())] for t in texts], pa.list_(pa.int64()))

    rows = items.select(F.monotonically_increasing_id().alias("number"), F.col("item_id").cast("string").alias("item"), terms("text").alias("terms"))
    return written(rows.filter(F.size("terms") > 0), "items")


def phrases(terms: list[int], window: int) -> Iterator[list[int]]:
    """The windows of an item's words; an item of fewer words is one."""
    return (terms[k : k + window] for k in range(max(len(terms) - window, 0) + 1))


class Segment:
    """The postings that one segment has of the terms asked for, and its documents."""

    def __init__(self, postings: pd.DataFrame):
        of_documents = postings["doc_ids"].notna()
        about = postings[of_documents]
        self.doc_ids, self.firsts, self.lengths = (np.frombuffer(b"".join(about[c]), "<i8") for c in ("doc_ids", "firsts", "lengths"))
        rows = postings[~of_documents]
        self._raw = {int(t): raw for t, raw in zip(rows["term"], rows["places"], strict=True)}
        self._places: dict[int, np.ndarray] = {}

    def __contains__(self, term: int) -> bool:
        return term in self._raw

    def count(self, term: int) -> int:
        return len(self._raw[term])

    def places(self, term: int) -> np.ndarray:
        if term not in self._places:
            self._places[term] = np.cumsum(np.frombuffer(self._raw[term], "<u4"), dtype=np.int64)
        return self._places[term]

    def occurrences(self, phrase: list[int], slack: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
        """The documents (by place) in which a phrase occurs, and the places that its terms then take."""
        order = sorted(range(len(phrase)), key=lambda offset: self.count(phrase[offset]))
        rarest = self.places(phrase[order[0]])
        documents = np.searchsorted(self.firsts, rarest, side="right") - 1
        bases = rarest - order[0]
        if slack:  # every base from which the rarest term is near enough
            bases = (bases[:, None] + np.arange(-slack, slack + 1)).ravel()
            documents = np.repeat(documents, 2 * slack + 1)
        reach = []
        for offset in order:
            if not len(bases):
                break
            places = self.places(phrase[offset])
            low = np.searchsorted(places, np.maximum(bases + offset - slack, self.firsts[documents]))
            high = np.searchsorted(places, np.minimum(bases + offset + slack, self.firsts[documents] + self.lengths[documents] - 1), side="right")
            there = low < high
            bases, documents = bases[there], documents[there]
            reach = [(p, a[there], b[there]) for p, a, b in reach] + [(places, low[there], high[there])]
        return np.unique(documents), [_between(*r) for r in reach] if len(bases) else []

    def hits(self, items: pd.DataFrame, window: int, slack: int = 0) -> pd.DataFrame:
        """doc_id, n_words, n_hit, items of every document."""
        hit = np.zeros(int(self.firsts[-1] + self.lengths[-1]) if len(self.firsts) else 0, dtype=bool)
        found: dict[int, set[str | None]] = {}
        seen: set[tuple[str | None, bytes]] = set()
        for item, terms in zip(items["item"], items["terms"], strict=True):
            terms = [int(t) for t in terms]
            known = [t in self for t in terms]
            for k, phrase in enumerate(phrases(terms, window)):
                if not all(known[k : k + len(phrase)]):
                    continue
                key = (item, np.array(phrase, dtype="<i8").tobytes())
                if key in seen:
                    continue
                seen.add(key)
                documents, taken = self.occurrences(phrase, slack)
                for places in taken:
                    hit[places] = True
                if taken:
                    for document in documents:
                        found.setdefault(int(document), set()).add(item)
        covered = np.concatenate(([0], np.cumsum(hit)))
        n_hit = covered[self.firsts + self.lengths] - covered[self.firsts]
        listed = [sorted(found.get(k, ()), key=lambda item: (item is None, item or "")) for k in range(len(self.doc_ids))]
        return pd.DataFrame({"doc_id": self.doc_ids, "n_words": self.lengths, "n_hit": n_hit.astype(np.int64), "items": listed})


def _between(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All of places[a:b] for the pairs of low and high."""
    edges = np.zeros(len(places) + 1, dtype=np.int64)
    np.add.at(edges, low, 1)
    np.add.at(edges, high, -1)
    return places[np.cumsum(edges[:-1]) > 0]


def _search(postings: pd.DataFrame, items: pd.DataFrame, window: int, slack: int) -> pd.DataFrame:
    """The hits in one segment. A null item comes as a missing value of any kind."""
    return Segment(postings).hits(items.assign(item=[None if pd.isna(i) else i for i in items["item"]]), window, slack)


def _asked(items: DataFrame, postings: DataFrame, window: int, limit: int = BROADCAST_IDS) -> DataFrame:
    """in_segment, item, terms: an item for each segment that holds the rarest term of one of its phrases.

    What is known of terms is counted and broadcast up to ``limit`` rows, so that
    a frequent word doesn't gather its phrases in one task; beyond, it is shuffled.
    """
    frequency = small_side(postings.groupBy("term").agg(F.sum("n").alias("df")), "frequency", limit)
    offsets = F.sequence(F.lit(0), F.greatest(F.size("terms") - window, F.lit(0)))
    cut = items.select("number", F.posexplode(F.transform(offsets, lambda k: F.slice("terms", k + 1, F.lit(window)))).alias("phrase", "terms"))
    ranked = cut.select("number", "phrase", F.explode("terms").alias("term")).join(frequency, "term", "left")
    # a term without postings has no frequency, and a phrase with such a term is nowhere
    rarest = ranked.groupBy("number", "phrase").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.bool_and(F.col("df").isNotNull()).alias("known"))
    routed = small_side(rarest.filter("known").select("number", "term").distinct(), "routed", limit)
    where = postings.select("segment", "term").join(routed, "term").select(F.col("segment").alias("in_segment"), "number").distinct()
    return where.join(items, "number").select("in_segment", "item", "terms")


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = 0) -> DataFrame:
    """doc_id, n_words, n_hit, items for every indexed document.

    ``items`` are as ``item_terms`` gives them. ``slack`` 0 asks for exact
    phrases; above that, each term may stand up to so many places away from where
    the phrase has it (proximity).
    """
    wanted = items.select(F.explode("terms").alias("term")).distinct()
    postings = index.filter("term is not null").join(wanted, "term", "left_semi").select("segment", "term", "n", "places")
    documents = index.filter("term is null").select("segment", F.lit(0).cast("long").alias("term"), "n", "places", "doc_ids", "firsts", "lengths")
    rows = postings.unionByName(documents, allowMissingColumns=True)
    asked = _asked(items, postings.select("segment", "term", "n"), window)
    look = lambda left, right: _search(left, right, window, slack)
    return rows.groupBy("segment").cogroup(asked.groupBy("in_segment")).applyInPandas(look, HITS).withColumn("doc_id", restored())


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    hits = search(build_index(docs), item_terms(items), window)
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win FROM i, range(1, greatest(len(w) - 10, 0) + 2) r(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win FROM d, sizes, range(1, greatest(len(w) - k, -1) + 2) r(s)),
hit AS (SELECT doc_id, item, s, dw.k FROM dw JOIN win ON dw.win = win.win AND dw.k = win.k),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, range(s, s + k) r(p) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
