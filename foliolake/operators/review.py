"""The review queue: inbox, validation, settlement partition, ledgers and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The states of an event, its delivery and its decision.
STATUSES = ("draft", "queued", "acknowledged")
DELIVERIES = ("staged", "in_progress", "applied", "acknowledged")
DECISIONS = ("accept", "reject", "defer")
PHASES = ("intent", "prepared", "published", "committed", "completed")


def validation_error() -> Column:
    """The first thing wrong with an event, or null."""
    return (
        F.when(~F.col("status").isin(*STATUSES), "unknown-status")
        .when(F.col("review_decision").isNotNull() & ~F.col("review_decision").isin(*DECISIONS), "unknown-decision")
        .when(F.col("paragraph_id").isNull(), "missing-paragraph")
        .when(F.octet_length("paragraph_id") > 3, "paragraph-id-too-long")
        .when(F.col("value") <= 0.1, "empty-value")
    )


def inbox(events: DataFrame, acknowledged: bool = False) -> DataFrame:
    return events.filter(F.col("status").isin("queued", *(["acknowledged"] if acknowledged else [])))


def settlement_group() -> Column:
    """Where an event's decision goes: settle, carry-forward, done or none."""
    return (
        F.when(F.col("review_decision").isNull(), "none")
        .when(F.col("delivery_state").isin("applied", "acknowledged") & (F.col("review_decision") != "defer"), "done")
        .when(F.col("review_decision") == "defer", "carry-forward")
        .otherwise("settle")
    )


def counts_by(events: DataFrame, key: str, column: str, values: tuple[str, ...]) -> DataFrame:
    """Per key, a count for each value, zeros kept."""
    return events.groupBy(key).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def last_states(events: DataFrame, key: str) -> DataFrame:
    """Each key's last status, delivery and decision, each the last that isn't null."""
    at = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("created_at", "event_id"))).alias(c)
    return events.groupBy(key).agg(at("status"), at("delivery_state"), at("review_decision"), F.max("created_at").alias("updated_at"))


def ledger(rows: DataFrame, operation: str, digest: str, order: str) -> DataFrame:
    """An operation's first input runs; the same input again is replayed, another is rejected."""
    window = Window.partitionBy(operation).orderBy(order)
    first = F.first(digest).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    outcome = F.when(F.row_number().over(window) == 1, "ran").when(F.col(digest) == first, "replayed").otherwise("rejected")
    return rows.withColumn("outcome", outcome)


def recovery(last_phase: Column, pointer: Column, prepared: Column, parent: Column) -> Column:
    """What to do with a generation transaction after a crash."""
    return (
        F.when(last_phase == "completed", "settle")
        .when(pointer.eqNullSafe(prepared), "roll-forward")
        .when(pointer.eqNullSafe(parent), "roll-back")
        .otherwise("quarantine")
    )
