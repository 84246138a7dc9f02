"""Streams with state by key and timers: token buckets of clients, and the ledger of operations.

Each key's state is a row in the state store, which Spark checkpoints with the
stream, so a restart goes on where it stopped, and keys spread over all tasks. A
timer removes a bucket when it would be full again: a full bucket is what an
unknown client has, so forgetting it changes nothing, and the state holds only
clients that were there lately. The ledger keeps the operations of a hash group
in one state. Its entries stay unless a time to keep them is given; then an
operation that comes back after it runs again, and a state drops its old entries
when its next event comes.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Bucket sizes are counted in the microseconds that fill them, so that sums are exact.
CAPACITY, COST = 5 * 600_000_000, 600_000_000
ALLOWED = "event_id long, client_id long, allowed boolean, tokens long"
#: States over which the ledger's operations are spread by hash.
LEDGER_GROUPS = 4096
OUTCOMES = "event_id long, operation_id string, outcome string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """Streams started from now on keep their state on disk, which keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """A key's rows of one batch; a batch is bounded by the stream's trigger."""
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), kind="stable")


class Bucket(StatefulProcessor):
    """Lets a client's request pass if its bucket holds COST; a bucket fills by one for each microsecond, up to CAPACITY."""

    def __init__(self, timed: bool):
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "held long, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, at = self.bucket.get() if self.bucket.exists() else (CAPACITY, None)
        batch, allowed, left = _in_order(rows, "micros", "event_id"), [], []
        for now in batch["micros"].tolist():
            # a request from before the last one finds the bucket as it is
            held = held if at is None else min(CAPACITY, held + max(0, now - at))
            at = now if at is None else max(at, now)
            allowed.append(held >= COST)
            held -= COST * allowed[-1]
            left.append(held)
        self.bucket.update((held, at))
        if self.timed:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((at + CAPACITY - held) // 1000 + 1)
        yield pd.DataFrame({"event_id": batch["event_id"], "client_id": key[0], "allowed": allowed, "tokens": left})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        return iter(())

    def close(self) -> None:
        pass


def _entered(known: dict, batch: pd.DataFrame, now: int) -> list[str]:
    """The outcome of each event of a batch in order; ``known`` (operation to its first input and when it was last seen) follows."""
    outcomes = []
    for operation, given in zip(batch["operation_id"].tolist(), batch["input"].tolist(), strict=True):
        operation, given = (x if isinstance(x, str) else None for x in (operation, given))
        first = known.get(operation)
        outcomes.append("ran" if first is None else "replayed" if given is not None and given == first[0] else "rejected")
        known[operation] = (given if first is None else first[0], now)
    return outcomes


def _ledger_of(keep: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """An operation runs once; the same input again is replayed, another one is rejected. ``keep`` is in milliseconds."""

    def enter(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = 0 if keep is None else state.getCurrentProcessingTimeMs()
        entries = json.loads(state.get[0]) if state.exists else []
        known = {operation: (first, at) for operation, first, at in entries if keep is None or now < at + keep}
        batch = _in_order(rows, "event_id")
        outcomes = _entered(known, batch, now)
        state.update((json.dumps([(operation, *of) for operation, of in known.items()], ensure_ascii=False, separators=(",", ":")),))
        yield pd.DataFrame({"event_id": batch["event_id"], "operation_id": batch["operation_id"], "outcome": outcomes})

    return enter


def throttled(requests: DataFrame, at: str = "created_at", delay: str | None = None) -> DataFrame:
    """allowed, and the tokens left, of each request of a stream (event_id, client_id, micros, and the time ``at``).

    With a ``delay``, buckets that would be full are forgotten once the watermark
    passes them, and requests that come later than that are dropped, as Spark does
    with what is behind the watermark. Without one every request is answered and
    every client's bucket stays.
    """
    with_state_store(requests.sparkSession)
    timed = delay is not None
    keyed = (requests.withWatermark(at, delay) if timed else requests).groupBy("client_id")
    return keyed.transformWithStateInPandas(Bucket(timed), outputStructType=ALLOWED, outputMode="append", timeMode="EventTime" if timed else "None")


def ledger(operations: DataFrame, keep: dt.timedelta | None = None, groups: int = LEDGER_GROUPS) -> DataFrame:
    """outcome (ran, replayed, rejected) of each event of a stream (event_id, operation_id, input).

    Operations share states by hash, so that a batch costs a call for each group
    that it touches and not for each operation. A stream that restarts needs the
    number of ``groups`` that it began with.
    """
    with_state_store(operations.sparkSession)
    kept = None if keep is None else max(1, int(keep.total_seconds() * 1000))
    grouped = operations.select("event_id", "operation_id", "input", F.pmod(F.xxhash64("operation_id"), F.lit(groups)).alias("ledger_group")).groupBy("ledger_group")
    return grouped.applyInPandasWithState(_ledger_of(kept), OUTCOMES, "entries string", "append", GroupStateTimeout.NoTimeout)
