from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, fp string, gone int, term string, part string, level string"

#: Null, empty, blank and very long texts, repeated rows, ties, and columns whose names operators use inside.
ODD = [
    (1, None, "en", "s"),
    (2, "", None, "s"),
    (3, " \n\t ", "en", None),
    (4, "one word after another makes a line\n" * 4000, "en", "s"),
    (4, "one word after another makes a line\n" * 4000, "en", "s"),
    (5, "x" * 200_000, "e n", "s"),
    (6, 'here token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" stands', "EN", "s"),
    (None, "a row without an id", "en", "s"),
    (None, None, None, None),
    (2**60 + 1, "a large id is exact", "en", "s"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, lang, s, len(t or ""), 0, "x", 0, "t", "p", "l") for i, t, lang, s in ODD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
