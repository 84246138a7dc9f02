from __future__ import annotations

import datetime as dt
import time

import pytest

from foliolake.streaming import keyed_state

SCHEMA = "event_id long, operation_id string, input string"


def _run(spark, tmp_path, batches, pause=0.0, **how):
    """Outcomes by event, and the states that are left, after each batch as a run of its own."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/in/{k}.parquet")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*.parquet")
        writer = keyed_state.ledger(stream, **how).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        running = writer.format("parquet").option("path", f"{tmp_path}/out").outputMode("append").start()
        running.awaitTermination()
        time.sleep(pause)
    states = running.lastProgress["stateOperators"][0]["numRowsTotal"]
    return {r.event_id: r.outcome for r in spark.read.parquet(f"{tmp_path}/out").collect()}, states


def test_operations_share_states(spark, tmp_path):
    """A state for each operation would make 90 of them."""
    batches = [[(100 * k + i, f"o{(7 * k + i) % 90}", f"v{i % 2}") for i in range(90)] for k in range(2)]
    out, states = _run(spark, tmp_path, batches, groups=4)
    first, expected = {}, {}
    for n, operation, given in sum(batches, []):
        expected[n] = "ran" if operation not in first else "replayed" if first[operation] == given else "rejected"
        first.setdefault(operation, given)
    assert out == expected and states <= 4


def test_an_operation_without_input_runs_once(spark, tmp_path):
    out, _ = _run(spark, tmp_path, [[(1, "a", None), (2, "a", None), (3, None, "x")], [(4, "a", "x"), (5, None, "x"), (6, 'q"\\ü', "x")]])
    assert out == {1: "ran", 2: "rejected", 3: "ran", 4: "rejected", 5: "replayed", 6: "ran"}


@pytest.mark.parametrize(("keep", "second"), [(dt.timedelta(milliseconds=200), "ran"), (dt.timedelta(hours=1), "rejected")])
def test_entries_are_kept_for_a_time(spark, tmp_path, keep, second):
    out, _ = _run(spark, tmp_path, [[(1, "a", "x")], [(2, "a", "y"), (3, "b", "x")]], pause=1, keep=keep)
    assert out == {1: "ran", 2: second, 3: "ran"}

