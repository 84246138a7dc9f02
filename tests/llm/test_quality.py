"""Quality rules and the quality classifier."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolake.llm import quality_classifier, quality_rules
from foliolake.llm.storage import table


def test_rules_equal_sql(spark, tiny, against_sql):
    against_sql(spark, quality_rules.op4_quality_rules, quality_rules.ORACLE_SQL, tiny)


def brute_repeat_words(words: list[str]) -> int:
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    return len({p for i, w in enumerate(windows) if w in twice for p in range(i, i + 8)})


@pytest.mark.parametrize("text", ["", "a b", "a " * 8, "a " * 9, "a b c d e f g h " * 2, "a b c d e f g h i x a b c d e f g h i", " ".join(f"w{k % 13}" for k in range(60)), " ".join(f"w{k}" for k in range(500))])
def test_repeat_words_equal_brute_force(spark, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    frame = spark.createDataFrame([(words,)], "w array<string>")
    assert frame.select(quality_rules.repeat_words(F.col("w"))).first()[0] == brute_repeat_words(words)


@pytest.mark.parametrize(("n", "k", "alpha"), [(10, 0, 0.05), (200, 3, 0.02), (1000, 10, 0.02), (5000, 60, 0.02), (50, 1, 0.02), (20, 5, 0.1)])
def test_binomial_tail_is_exact(spark, n, k, alpha):
    exact = sum(math.comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(k + 1)) if k < n * alpha else 1.0
    found = spark.range(1).select(quality_rules.binomial_tail(F.lit(n), F.lit(k), alpha)).first()[0]
    assert found == pytest.approx(exact, rel=1e-9)


def test_a_level_that_rejects_too_many_is_not_chosen(spark):
    levelled = [(k, "en", 20 if k % 10 else 5) for k in range(1000)] + [(2000 + k, "de", 20) for k in range(1000)] + [(5000, "fr", 20)]
    frame = spark.createDataFrame(levelled, "doc_id long, stratum string, level int")
    labels = frame.select("doc_id", F.lit(1).alias("quality"))
    chosen = {r.stratum: r.safe_level for r in quality_rules.thresholds(frame, labels).collect()}
    assert chosen == {"en": 5, "de": 20, "fr": 0}


def test_rules_run_no_python(spark, tiny):
    plan = quality_rules.op4_quality_rules(spark, tiny)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rules_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (6, None), (99, 1)], "doc_id long, quality int")
    rows = quality_rules.judge(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 20)
    long = [r for r in rows if r.doc_id == 4]
    assert {(r.n_words, r.n_dup_lines, r.n_repeat_words) for r in long} == {(28_000, 3999, 28_000)}
    assert quality_rules.judge(empty, labels).count() == 0
    assert quality_rules.judge(odd, labels.limit(0)).count() == len(rows)


def test_classifier_on_the_held_out_fold(spark, tiny):
    import pathlib

    folder = str(pathlib.Path(tiny).with_name("sf0.01"))
    rows = quality_classifier.op5_quality_classifier(spark, folder).join(table(spark, folder, "labels"), "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    assert right > 0.95
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_classifier_folds_and_range(spark, tiny):
    import zlib

    rows = quality_classifier.op5_quality_classifier(spark, tiny).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(0)
    n = len(quality_classifier.features(""))
    worth = rng.normal(size=n)
    rows = rng.normal(size=(600, n))
    labels = (rows @ worth > 1.5).astype(int)
    scores = quality_classifier.bradley_terry(rows, labels).scores(rows)
    assert scores[labels == 1].mean() > 0.8 and scores[labels == 0].mean() < 0.1


def test_classifier_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 7)], "doc_id long, quality int")
    model = quality_classifier.fitted(odd, labels)
    rows = quality_classifier.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.score(empty, model).count() == 0
    alone = quality_classifier.fitted(odd, labels.limit(0))
    assert {r.score for r in quality_classifier.score(odd, alone).collect()} == {0.5}
    assert quality_classifier.with_quantile(quality_classifier.score(empty, model)).count() == 0


def test_quantile_threshold_keeps_its_share(spark):
    scored = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") / 1000).alias("score"))
    kept = quality_classifier.with_quantile(scored, 0.3).filter("above_quantile")
    assert kept.count() == pytest.approx(700, abs=2) and kept.agg(F.min("score")).first()[0] >= 0.299


def test_rows_that_come_to_the_driver_are_bounded(spark, monkeypatch):
    rows = [(1, f"good text number {k}") for k in range(3000)] + [(2, "#### $$$$ %%%%")] * 3000
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_classifier, "bradley_terry", lambda x, y: seen.append(len(x)))
    quality_classifier.fitted(docs, labels, train_rows=500)
    assert seen == [500]


def test_levels_above_zero_reject_as_the_sql_does(spark, tiny, against_sql, tmp_path):
    """Labels planted so that every language has enough good documents for a level."""
    folder = tiny.replace("sf0.001", "sf0.01")
    docs = table(spark, folder, "documents")
    for k in range(4):
        copies = docs.withColumn("doc_id", F.col("doc_id") + 1_000_000 * k)
        copies.coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
    spark.read.parquet(f"{tmp_path}/d").coalesce(1).write.parquet(f"{tmp_path}/one")
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    rows = table(spark, str(tmp_path), "documents")
    levelled = quality_rules.base_metrics(rows).select("doc_id", "base_failed", quality_rules.survived_level().alias("level"))
    labels = levelled.select("doc_id", (~F.col("base_failed") & (F.col("level") >= 12)).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    labels.coalesce(1).write.parquet(f"{tmp_path}/l")
    next((tmp_path / "l").glob("*.parquet")).rename(tmp_path / "labels.parquet")
    against_sql(spark, quality_rules.op4_quality_rules, quality_rules.ORACLE_SQL, str(tmp_path))
    judged = quality_rules.judge(rows, table(spark, str(tmp_path), "labels")).join(rows.select("doc_id", "lang"), "doc_id")
    rejected = {r.lang: r.n for r in judged.filter("not kept and not base_failed").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert set(rejected) == {r.lang for r in rows.select("lang").distinct().collect()} and min(rejected.values()) > 0
