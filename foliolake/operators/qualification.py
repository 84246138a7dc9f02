"""Audits of a capability map: capabilities, their states, and the cases that prove them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The states of a capability, the kinds of a case, and what a case probes.
STATES = ("supported", "supported-with-guard", "unsupported-by-design")
KINDS = ("task", "agent", "matrix", "metamorphic")
ALLOWED = ("positive", "guard-allowed")
REFUSED = ("guard-refused", "stable-negative")
NEGATIVE = ("negative", "stable-negative")


def _found(rows: DataFrame, subject: str, checks: dict) -> DataFrame:
    """problem, subject for each check that holds in a row."""
    names = F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in checks.items()])
    return rows.select(F.explode(F.filter(names, lambda n: n.isNotNull())).alias("problem"), F.col(subject).cast("string").alias("subject"))


def capability_audit(manifest: DataFrame, mapped: DataFrame, referenced: DataFrame, cases: DataFrame) -> DataFrame:
    """problem, subject (a capability or case) of a map that doesn't agree with its manifest.

    ``manifest`` and ``mapped`` are (capability, state), ``referenced`` is
    (capability, case) and ``cases`` is (case, capability, kind, probe). A case
    belongs to one capability, which it names itself; a capability has cases, a
    guarded one some on either side, an unsupported one a negative one.
    """
    users = referenced.groupBy("case").agg(F.count_distinct("capability").alias("users"), F.min("capability").alias("user"))
    declared = cases.select("case", F.col("capability").alias("declared"), "kind", "probe")
    by_case = users.join(declared, "case", "full_outer")
    both = F.col("users").isNotNull() & F.col("declared").isNotNull()
    of_cases = _found(by_case, "case", {
        "case-of-several": F.col("users") > 1,
        "case-not-declared": F.col("declared").isNull(),
        "case-not-referenced": F.col("users").isNull(),
        "case-of-another": both & (F.col("users") == 1) & (F.col("user") != F.col("declared")),
        "unknown-kind": both & ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)),
    })
    probes = lambda names: F.count_if(F.col("probe").isin(*names))
    proof = referenced.join(declared, "case", "left").groupBy("capability").agg(F.count("*").alias("n"), probes(ALLOWED).alias("allowed"), probes(REFUSED).alias("refused"), probes(NEGATIVE).alias("negative"))
    wanted = manifest.select("capability", F.col("state").alias("wanted"), F.lit(True).alias("in_manifest"))
    rows = wanted.join(mapped.select("capability", "state", F.lit(True).alias("in_map")), "capability", "full_outer").join(proof, "capability", "left")
    known = F.col("in_manifest") & F.col("in_map")
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    of_capabilities = _found(rows, "capability", {
        "unknown-state": F.col("in_manifest") & ~F.coalesce(F.col("wanted").isin(*STATES), F.lit(False)),
        "missing-from-map": F.col("in_map").isNull(),
        "not-in-manifest": F.col("in_manifest").isNull(),
        "state-differs": known & ~F.col("state").eqNullSafe(F.col("wanted")),
        "empty-case-set": known & none("n"),
        "no-negative-case": known & (F.col("wanted") == "unsupported-by-design") & none("negative"),
        "one-sided-guard": known & (F.col("wanted") == "supported-with-guard") & (none("allowed") | none("refused")),
    })
    return of_capabilities.unionByName(of_cases)
