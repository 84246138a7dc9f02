from __future__ import annotations

import hashlib
import random
import re

from foliolake.llm import decontamination as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        windows += [(str(item), w[k : k + 10]) for k in range(max(len(w) - 9, 1) if w else 0)]
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, window in windows:
            for s in range(len(w) - len(window) + 1):
                if w[s : s + len(window)] == window:
                    hit |= set(range(s, s + len(window)))
                    found.add(item)
        out[doc_id] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_equals_sql(spark, tiny, against_sql):
    against_sql(spark, op.op8_decontamination, op.ORACLE_SQL, tiny)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["the", "a", "ö1", "B", "cat", "dog", "x9"]
    passage = [rng.choice(vocabulary) for _ in range(14)]
    items = [(1, " ".join(passage)), (2, "the cat"), (3, "!!! --"), (4, None), (10, ". ".join(passage[2:13])), (5, "the the the the the the the the the the the")]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for k in range(60)]
    docs += [(100 + k, "Ünder " * k + "-".join(passage) + "\nthe end") for k in range(5)]
    docs += [(200, None), (201, ""), (202, "the " * 30), (203, " ".join(passage[:9])), (204, " ".join(passage) + " " + " ".join(passage))]
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = op.contamination(left.repartition(3), right).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == brute(docs, items)


def test_small_segments_give_the_same(spark, tiny):
    from foliolake.llm.storage import table

    docs, items = table(spark, tiny, "documents"), op.item_terms(table(spark, tiny, "benchmark"))
    whole = {(r.doc_id, r.n_hit, tuple(r["items"])) for r in op.search(op.build_index(docs), items).collect()}
    parts = {(r.doc_id, r.n_hit, tuple(r["items"])) for r in op.search(op.build_index(docs, segment_words=500), items).collect()}
    assert whole == parts


def test_proximity_allows_slack(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha of beta then gamma"), (3, "gamma far away from any of the others alpha")], "doc_id long, text string")
    phrase = op.item_terms(spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string"))
    hits = lambda slack: {r.doc_id for r in op.search(op.build_index(docs), phrase, slack=slack).collect() if r.n_hit}
    assert hits(0) == {1} and hits(2) == {1, 2}


def brute_proximity(docs, items, window, slack):
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, item_text in items:
            t = words(item_text)
            for k in range(max(len(t) - window, 0) + 1) if t else ():
                phrase = t[k : k + window]
                for base in range(-len(phrase) - slack, len(w) + slack + 1):
                    near = [[p for p in range(max(0, base + o - slack), min(len(w), base + o + slack + 1)) if w[p] == x] for o, x in enumerate(phrase)]
                    if all(near):
                        found.add(str(item))
                        hit |= {p for ps in near for p in ps}
        out[doc_id] = (len(w), len(hit), sorted(found))
    return out


def test_proximity_equals_brute_force(spark):
    rng = random.Random(9)
    draw = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    docs = [(k, draw(rng.randrange(12))) for k in range(120)] + [(500, "a b"), (501, "c d"), (502, "b a"), (503, "x y")]
    items = [(1, "b c"), (2, "a b"), (3, draw(4)), (4, draw(7)), (5, "g"), (6, "a a")]
    index = op.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2))
    terms = op.item_terms(spark.createDataFrame(items, "item_id long, text string"))
    for slack in range(4):
        rows = op.search(index, terms, window=3, slack=slack).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in rows} == brute_proximity(docs, items, 3, slack)


def test_an_item_is_sent_to_a_segment_once(spark):
    docs = spark.createDataFrame([(k, f"rare{k % 3} one two three four five six seven eight nine ten eleven rare{k % 3}") for k in range(9)], "doc_id long, text string").coalesce(1)
    items = op.item_terms(spark.createDataFrame([(1, "rare0 one two three four five six seven eight nine ten eleven rare0"), (2, "rare7 one two")], "item_id long, text string"))
    postings = op.build_index(docs, segment_words=13).filter("term is not null").select("segment", "term", "n")
    asked = op._asked(items, postings, op.WINDOW).collect()
    assert sorted(map(repr, asked)) == sorted(map(repr, op._asked(items, postings, op.WINDOW, limit=0).collect()))
    assert len(asked) == len({(r.in_segment, r.item) for r in asked}) == 9 and {r.item for r in asked} == {"1"}


def test_items_without_an_id_and_one_named_null_are_two(spark):
    items = spark.createDataFrame([(None, "alpha beta"), ("null", "gamma delta"), (None, "beta gamma")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "gamma delta"), (3, "alpha beta")], "doc_id long, text string")
    rows = {r.doc_id: (r.n_items, r.items_sha256, r.n_hit) for r in op.contamination(docs, items).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert rows == {1: (2, sha("null"), 4), 2: (1, sha("null"), 2), 3: (1, sha(""), 2)}


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "one word after another makes a line one word after another"), (None, "a row without an id")], "item_id long, text string")
    rows = op.contamination(odd, items).collect()
    assert len(rows) == odd.count()
    assert sorted(str(r.doc_id) for r in rows if r.contaminated) == ["4", "4", "None"]
    assert op.contamination(empty, items).count() == 0
    assert not any(r.contaminated for r in op.contamination(odd, items.limit(0)).collect())
