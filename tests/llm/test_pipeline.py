from __future__ import annotations

import random

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from foliolake.llm import bpe, secret_scan
from foliolake.llm.storage import table, without_ids, written
from test_decontamination import brute
from test_simhash import brute_components, brute_fingerprint
from test_tokens import _check_packing


def test_each_stage_against_brute_force(spark, tiny):
    docs = table(spark, tiny, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = written(stage(spark, docs, tiny), name)
        after = {r.doc_id: r for r in out.collect()}
        if name != "best_fit_packing":
            assert out.columns == columns and len(after) == out.count()
        if name == "quality_rules":
            from foliolake.llm.quality_rules import judge

            kept = {r.doc_id for r in judge(docs, table(spark, tiny, "labels")).filter("kept").collect()}
            assert set(after) == kept and 0 < len(kept) < len(before)
        elif name == "simhash_near_dedup":
            roots = brute_components([(d, brute_fingerprint(r.text)) for d, r in before.items()])
            assert set(after) == set(roots.values())
        elif name == "benchmark_decontamination":
            hits = brute([(d, r.text) for d, r in before.items()], [(r.item_id, r.text) for r in table(spark, tiny, "benchmark").collect()])
            assert set(after) == {d for d, h in hits.items() if not h[4]}
        elif name == "secret_scans":
            assert set(after) == set(before)
            for d, r in after.items():
                found = secret_scan.base_spans(before[d].text)
                assert not secret_scan.base_spans(r.text)
                assert found or r.text == before[d].text or "[SECRET]" in r.text
                assert r.n_chars == len(r.text)
        else:
            library = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
            _check_packing(out.collect(), {d: [*library.encode(r.text, add_special_tokens=False).ids, 2] for d, r in before.items()})
        docs = out


def test_run_gives_the_last_stage(spark, tiny):
    assert corpus_pipeline.run(spark, tiny).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_odd_rows_pass_every_stage(spark, odd, empty, tiny):
    docs, none = odd, empty
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs, none = written(stage(spark, docs, tiny), name), written(stage(spark, none, tiny), name)
        if name != "best_fit_packing":
            assert docs.columns == odd.columns
        assert none.count() == 0
    assert {r.doc_id for r in docs.collect()} >= {None, 1, 4, 5, 6, 2**60 + 1}


def test_odd_rows_pass_the_quality_stage(spark, odd, empty, tiny):
    kept = corpus_pipeline.quality(spark, odd.withColumn("text", F.when(F.col("doc_id") == 6, F.concat(F.lit("these are "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.concat(F.lit("w"), k)), " "))).otherwise(F.col("text"))), tiny)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()] == [6]
    assert corpus_pipeline.quality(spark, empty, tiny).count() == 0


def test_the_row_that_stays_does_not_depend_on_how_rows_are_dealt(spark, tiny):
    words = [f"word{k}" for k in range(60)]
    texts = [" ".join(words), " ".join(words).upper(), " ".join(words).title(), "\t".join(words)]  # one fingerprint
    docs = spark.createDataFrame([(3, t) for t in texts], "doc_id long, text string")
    left = {tuple(r.text for r in corpus_pipeline.near_duplicates(spark, docs.orderBy(F.rand(k)).repartition(k + 1), tiny).collect()) for k in range(3)}
    assert len(left) == 1 and len(left.pop()) == 1


def test_ids_beyond_the_bound_are_joined_by_a_shuffle(spark, odd):
    gone = spark.createDataFrame([(4,), (None,)], "doc_id long")
    few, many = without_ids(odd, gone), without_ids(odd, gone, limit=0)
    assert sorted(r.doc_id for r in few.collect()) == sorted(r.doc_id for r in many.collect()) == [1, 2, 3, 5, 6, 2**60 + 1]


def test_rows_that_share_an_id_are_judged_one_by_one(spark, tiny):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(40)) for _ in range(6)]
    item = table(spark, tiny, "benchmark").filter("length(text) > 100").first().text
    rows = [(None, texts[1]), (None, texts[2]), (None, texts[2]), (None, "too short"), (7, texts[3]), (7, texts[4]), (7, "too short"), (7, item), (None, item + " ."), (3, texts[4]), (9, texts[5])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row_key long").repartition(3)
    left = lambda stage: sorted((r.doc_id or 0, r.text) for r in stage(spark, docs, tiny).collect())
    plain = [(i or 0, t) for i, t in rows]
    assert left(corpus_pipeline.quality) == sorted(r for r in plain if r[1] != "too short")
    groups = brute_components([(k, brute_fingerprint(t)) for k, (_, t) in enumerate(rows)])
    first = {root: min((i is None, i or 0, k) for k, (i, _) in enumerate(rows) if groups[k] == root)[2] for root in set(groups.values())}
    once = left(corpus_pipeline.near_duplicates)
    assert len(once) == len(first) and [i for i, _ in once] == sorted(rows[k][0] or 0 for k in first.values())
    assert {brute_fingerprint(t) for _, t in once} <= {brute_fingerprint(rows[k][1]) for k in first.values()}
    hits = brute([(k, t) for k, (_, t) in enumerate(rows)], [(r.item_id, r.text) for r in table(spark, tiny, "benchmark").collect()])
    assert left(corpus_pipeline.decontaminate) == sorted(r for k, r in enumerate(plain) if not hits[k][4])
    assert hits[7][4] and hits[8][4] and not hits[5][4]
