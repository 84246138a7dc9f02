from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliolake.streaming import keyed_state
from foliolake.streaming import review_stream as op

SCHEMA = "event_id long, client_id long, created_at timestamp, status string, operation_id string"


def _event(n, client, minute, status, operation="x"):
    return n, client, dt.datetime(2024, 1, 1, 0, minute), status, operation


def _files(spark, path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{k}.parquet")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*.parquet")


def test_late_events_dont_take_a_state_back(spark, tmp_path):
    batches = [[_event(1, 7, 5, "queued"), _event(2, 8, 1, "draft")], [_event(3, 7, 2, "draft")], [_event(4, 7, 5, "acknowledged")]]
    out = op.run_to_end(op.last_states(_files(spark, tmp_path, batches)), "states", "update")
    last = {}
    for r in out.orderBy("batch").collect():
        last[r.client_id] = (r.status, r.events)
    assert last == {7: ("acknowledged", 3), 8: ("draft", 1)}


def test_an_operation_passes_once(spark, tmp_path):
    batches = [[_event(1, 7, 1, "draft", "a"), _event(2, 7, 2, "draft", "b")], [_event(3, 7, 3, "draft", "a"), _event(4, 7, 4, "draft", "c")]]
    out = op.run_to_end(op.first_operations(_files(spark, tmp_path, batches), "operation_id"), "operations")
    assert sorted(r.operation_id for r in out.collect()) == ["a", "b", "c"]


def test_histories_hold_every_event_once(spark, tmp_path):
    batches = [[_event(k, 1, k, "draft")] for k in range(4)]
    out = op.run_to_end(_files(spark, tmp_path, batches).select("event_id"), "history")
    assert sorted(r.event_id for r in out.collect()) == [0, 1, 2, 3]


def test_operations_pass_once_however_late(spark, tmp_path):
    late = (3, 7, dt.datetime(2024, 4, 1), "draft", "a")
    batches = [[_event(1, 7, 1, "draft", "a"), late[:2] + (dt.datetime(2024, 6, 1), "draft", "b")], [late, _event(4, 7, 4, "draft", "c")], [_event(5, 7, 5, "draft", "b"), late[:2] + (dt.datetime(2024, 9, 1), "draft", "a")]]
    out = op.run_to_end(op.first_operations(_files(spark, tmp_path, batches), "operation_id"), "operations")
    assert sorted(r.operation_id for r in out.collect()) == ["a", "b", "c"]


def buckets(events: list[tuple]) -> dict[int, tuple[bool, int]]:
    """Each event's answer, one client after the other, in the order in which batches bring them."""
    held: dict = {}
    out = {}
    for batch in events:
        for n, client, when, *_ in sorted(batch, key=lambda e: (e[1], e[2], e[0])):
            micros = int(when.replace(tzinfo=dt.UTC).timestamp() * 1_000_000)
            tokens, at = held.get(client, (keyed_state.CAPACITY, micros))
            tokens = min(keyed_state.CAPACITY, tokens + max(0, micros - at))
            allowed = tokens >= keyed_state.COST
            held[client] = tokens - allowed * keyed_state.COST, max(at, micros)
            out[n] = allowed, held[client][0]
    return out


@pytest.mark.parametrize("delay", [None, "2 hours"])
def test_buckets_keep_their_state_over_batches_and_timers(spark, tmp_path, delay):
    batches = [[_event(20 * k + i, i % 3, (7 * k + i) % 60, "draft") for i in range(12)] for k in range(3)]
    batches.append([(99, 0, dt.datetime(2024, 1, 1, 9), "draft", "x"), (98, 5, dt.datetime(2024, 1, 1, 9, 1), "draft", "x")])
    batches.append([(97, 0, dt.datetime(2024, 1, 1, 12), "draft", "x")])
    stream = _files(spark, tmp_path, batches).withColumn("micros", F.unix_micros("created_at"))
    out = op.run_to_end(keyed_state.throttled(stream, delay=delay), "buckets")
    assert {r.event_id: (r.allowed, r.tokens) for r in out.collect()} == buckets(batches)


def test_ledgers_go_on_after_a_restart(spark, tmp_path):
    """The second run begins where the first stopped, with its state."""
    rows = [[_event(1, 7, 1, "draft", "a"), _event(2, 7, 2, "queued", "a"), _event(3, 7, 3, "draft", "b")], [_event(4, 7, 4, "draft", "a"), _event(5, 7, 5, "other", "b"), _event(6, 7, 6, "x", "c")]]
    spark.createDataFrame(rows[0], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/0.parquet")

    def run() -> None:
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*.parquet").withColumn("input", F.col("status"))
        writer = keyed_state.ledger(stream).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        writer.format("parquet").option("path", f"{tmp_path}/out").outputMode("append").start().awaitTermination()

    run()
    spark.createDataFrame(rows[1], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/1.parquet")
    run()
    out = {r.event_id: r.outcome for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert out == {1: "ran", 2: "rejected", 3: "ran", 4: "replayed", 5: "rejected", 6: "ran"}
