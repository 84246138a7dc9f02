from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from foliolake.llm import exact_dedup
from foliolake.llm.queries import ORACLE_SQL
from foliolake.llm.storage import looked_up, written


def brute(rows: list[tuple]) -> list[tuple]:
    """doc_id, keep_id, group_size, text_sha256 of rows (doc_id, text), by whole texts."""
    groups: dict[str, list] = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    largest = lambda ids: max((i for i in ids if i is not None), default=None)
    return [(d, largest(groups[t or ""]), len(groups[t or ""]), sha(t)) for d, t in rows]


def results(df) -> list[tuple]:
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr)


def test_query_equals_sql(spark, tiny, against_sql):
    against_sql(spark, exact_dedup.op11_exact_dedup, ORACLE_SQL["op11_exact_dedup"], tiny)


def test_odd_rows_equal_brute_force_at_any_block_size(spark, odd):
    expected = sorted(brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]), key=repr)
    for size in (20_000, 4096):
        found = exact_dedup.exact_duplicates(odd, size)
        assert results(found) == expected
        kept = Counter(r.text_sha256 for r in found.filter("kept").collect())
        assert set(kept.values()) == {1} and set(kept) == {x[3] for x in expected}


def test_empty_table(spark, empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.distinct_documents(empty).columns == empty.columns


def test_blocks_join_to_the_text_and_have_the_size(spark):
    texts = ["", "é" * 100, "a" * 8, "a" * 9, "a" * 16 + "é"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", exact_dedup.blocks(8).alias("b")).collect()
    for r in rows:
        raw = r.text.encode()
        assert [bytes(b) for b in r.b] == [raw[i : i + 8] for i in range(0, max(len(raw), 1), 8)]


def test_texts_that_differ_in_one_byte_or_in_order_of_blocks(spark):
    base = "".join(f"{i:04d}" for i in range(64))
    texts = [base, base[:-1] + "x", "x" + base[1:], base[4:8] + base[:4] + base[8:], base + "0", base[:-1], base * 2, base]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert results(exact_dedup.exact_duplicates(docs, 4)) == sorted(brute(rows), key=repr)


def test_shared_addresses_are_found_and_given_up(spark):
    """With a first seed that gives all blocks of a length one address, names still stand for one content."""
    rows = [(i, t) for i, t in enumerate(["abcd", "efgh", "abcd", "abcdefgh", "efghabcd", "abcdefgh", ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seeds = []

    def weak(block, seed):
        seeds.append(seed)
        if seed:
            return exact_dedup.address(block, seed)
        return F.struct(F.length(block).cast("long").alias("high"), F.lit(0).cast("long").alias("low"))

    found = exact_dedup.identified(docs, size=4, addressed=weak).collect()
    texts = dict(rows)
    assert set(seeds) == {0, 2}
    assert len({(r.level, r.name) for r in found}) == len(set(texts.values()))
    for r in found:
        assert {texts[x.doc_id] for x in found if (x.level, x.name) == (r.level, r.name)} == {texts[r.doc_id]}


def test_distinct_documents_keep_whole_rows(spark, odd):
    kept = exact_dedup.distinct_documents(odd)
    assert kept.columns == odd.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r.text or "" for r in odd.collect()})
    assert kept.filter("doc_id = 4").count() == 1


def test_hot_keys_are_looked_up_like_others(spark):
    rows = written(spark.range(1000).select((F.when(F.col("id") < 700, 0).otherwise(F.col("id"))).alias("k"), "id"), "rows")
    named = written(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first")), "named")
    for hot_keys, least in ((2, 1), (10**6, 1), (1, 10**6)):
        found = looked_up(rows, named, ["k"], hot_keys, least)
        assert found.count() == 1000 and found.filter("first <> least(k, id)").count() == 0


def test_main_path_has_no_python(spark, tiny):
    plan = exact_dedup.op11_exact_dedup(spark, tiny)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
