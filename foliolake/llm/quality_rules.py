"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule measures a ratio of a whole text. Its cutoff moves with a level common
to all rules, from loose (level 1) to tight (level ``LEVELS``), so a document
has one number: the highest level that it survives. Per stratum, the labelled
good documents are a holdout: at each level the number falsely rejected is
binomial, and the level is safe if P(Bin(n, ALPHA) <= rejected) is at most
DELTA over the number of strata (Bonferroni). Levels are tested from loose to
tight and testing stops at the first that isn't safe (a fixed sequence, so it
needs no further correction). The last safe level is the stratum's threshold:
with probability 1 - DELTA over all strata together, no stratum rejects more
than ALPHA of its good documents. A stratum with too few labels gets level 0,
which rejects nothing.

Strata are languages: two-letter codes as they are, anything else (and null) is
``other``; that bounds them to 677, so thresholds are broadcast.

Null and empty texts have no words, fail the base rule and are not kept. Labels
that are null, or whose document is absent, don't count; a document labelled
twice counts twice. Repeated rows stay. An empty table gives an empty result.
Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolake.llm.storage import table, written

ALPHA = 0.02
DELTA = 0.05
LEVELS = 20
#: Rule: (loose cutoff, tight cutoff); a document is rejected above the cutoff.
RULES = {
    "symbols": (0.5, 0.02),  # of [#*$%&|<>] for each character in words
    "capitals": (1.0, 0.2),  # capital letters for each character in words
    "repeats": (0.3, 0.2),  # words in repeated windows for each word
    "dup_lines": (0.9, 0.5),  # repeated lines for each line with a word
}
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8

_SPACE = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with ``value`` computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_places(hashes: Column) -> Column:
    """Of an array of window hashes: the places, in order, of those that occur twice or more."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda p, k, x: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
    keep = lambda p: F.filter(p, lambda x, k: same(p, k - 1, x) | same(p, k + 1, x))
    return F.sort_array(F.transform(_let(placed, keep), lambda x: x["i"]))


def repeat_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text, the first included.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes.
    """
    word_hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
    reach = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(window)), F.lit(window))), F.lit(0), lambda a, b: a + b)
    count = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_let(_repeated_places(w), reach))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(_let(_let(word_hashes, windows), count)).cast("long")


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def base_metrics(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` (doc_id, lang, text, ...) with the base counts, all long, and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    counted = docs.withColumns({"_words": words, "_lines": lines}).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": _length_without(text, _SPACE).cast("long"),
            "n_symbols": (F.length(text) - _length_without(text, "[#*$%&|<>]+")).cast("long"),
            "n_capitals": (F.length(text) - _length_without(text, "\\p{Lu}+")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeat_words(F.col("_words")),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).drop("_words", "_lines")


def stratum(lang: Column) -> Column:
    code = F.lower(lang)
    return F.when(code.rlike("^[a-z]{2}$"), code).otherwise(F.lit("other"))


def cutoffs(rule: str) -> list[float]:
    """The rule's cutoffs at levels 1 to LEVELS."""
    loose, tight = RULES[rule]
    return [round(loose + (tight - loose) * k / (LEVELS - 1), 6) for k in range(LEVELS)]


def survived_level() -> Column:
    """The highest level that a document with base metrics survives under all rules."""
    ratios = {
        "symbols": F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
        "capitals": F.col("n_capitals") / F.greatest("word_chars", F.lit(1)),
        "repeats": F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    }
    survived = []
    for rule, ratio in ratios.items():
        level: Column = F.lit(0)
        for k, cutoff in enumerate(cutoffs(rule), 1):  # the last that holds wins
            level = F.when(ratio <= F.lit(cutoff), F.lit(k)).otherwise(level)
        survived.append(level)
    return F.least(*survived)


def binomial_tail(n: Column, k: Column, alpha: float = ALPHA) -> Column:
    """P(Bin(n, alpha) <= k), summed term by term in logarithms; 1 where k reaches the mean."""
    start = F.struct((n * F.log1p(F.lit(-alpha))).alias("term"), (n * F.log1p(F.lit(-alpha))).alias("total"))
    odds = F.log(F.lit(alpha)) - F.log1p(F.lit(-alpha))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j) + odds
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.filter(F.sequence(F.lit(0).cast("long"), k.cast("long")), lambda j: j > 0)
    total = F.aggregate(steps, start, add, lambda acc: acc["total"])
    return F.when(k >= n * alpha, F.lit(1.0)).otherwise(F.exp(total))


def thresholds(levelled: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, safe_level for every stratum with good labels; ``levelled`` has doc_id, stratum, level."""
    good = labels.filter("quality = 1").select("doc_id")
    survivors = levelled.join(good, "doc_id").groupBy("stratum", "level").agg(F.count("*").alias("n"))
    strata = survivors.groupBy("stratum").agg(F.sum("n").alias("total")).withColumn("of_strata", F.count("*").over(Window.partitionBy(F.lit(1))))
    tested = strata.select("stratum", "total", "of_strata", F.explode(F.sequence(F.lit(1), F.lit(LEVELS))).alias("test"))
    falls = F.sum(F.when(F.col("level") < F.col("test"), F.col("n")).otherwise(0)).alias("rejected")
    counted = tested.join(survivors, "stratum").groupBy("stratum", "total", "of_strata", "test").agg(falls)
    safe = binomial_tail(F.col("total"), F.col("rejected"), alpha) <= F.lit(delta) / F.col("of_strata")
    first_unsafe = F.min(F.when(~safe, F.col("test")))
    return counted.groupBy("stratum").agg((F.coalesce(first_unsafe, F.lit(LEVELS + 1)) - 1).alias("safe_level"))


def judge(docs: DataFrame, labels: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``carried``, the base counts, base_failed and kept for every row of ``docs``."""
    measured = base_metrics(docs.select("doc_id", *carried, "lang", "text"))
    columns = ["doc_id", *carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    levelled = written(measured.select(*columns, stratum(F.col("lang")).alias("stratum"), survived_level().alias("level")), "rule-levels")
    safe = thresholds(levelled.select("doc_id", "stratum", "level"), labels)
    verdict = ~F.col("base_failed") & (F.col("level") >= F.coalesce("safe_level", F.lit(0)))
    return levelled.join(F.broadcast(safe), "stratum", "left").select(*columns, verdict.alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _level_sql(rule: str, ratio: str) -> str:
    cases = " ".join(f"WHEN {ratio} <= CAST({c!r} AS DOUBLE) THEN {k}" for k, c in reversed(list(enumerate(cutoffs(rule), 1))))
    return f"CASE {cases} ELSE 0 END"


ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT doc_id, s, array_to_string(w[s:s + {REPEAT_WINDOW - 1}], ' ') AS win FROM w, range(1, len(w) - {REPEAT_WINDOW - 2}) r(s)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM rep, range(s, s + {REPEAT_WINDOW}) r(p) GROUP BY doc_id),
m AS (SELECT w.doc_id, CASE WHEN regexp_full_match(lower(lang), '[a-z][a-z]') THEN lower(lang) ELSE 'other' END AS stratum,
  CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g')) AS BIGINT) AS n_capitals,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  least({_level_sql("symbols", "CAST(n_symbols AS DOUBLE) / greatest(word_chars, 1)")},
        {_level_sql("capitals", "CAST(n_capitals AS DOUBLE) / greatest(word_chars, 1)")},
        {_level_sql("repeats", "CAST(n_repeat_words AS DOUBLE) / greatest(n_words, 1)")},
        {_level_sql("dup_lines", "CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1)")}) AS level FROM m),
g AS (SELECT stratum, level FROM v JOIN labels USING (doc_id) WHERE quality = 1),
k AS (SELECT stratum, test, count(*) AS n, count(*) FILTER (level < test) AS k, (SELECT count(DISTINCT stratum) FROM g) AS strata FROM g, range(1, {LEVELS + 1}) r(test) GROUP BY ALL),
p AS (SELECT stratum, test, strata, CASE WHEN k >= n * {ALPHA} THEN 1.0 ELSE
  (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA}))) FROM range(0, k + 1) r(j)) END AS tail FROM k),
safe AS (SELECT stratum, coalesce(min(test) FILTER (tail > {DELTA} / strata), {LEVELS + 1}) - 1 AS safe_level FROM p GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND level >= coalesce(safe_level, 0) AS kept
FROM v LEFT JOIN safe USING (stratum)
"""
