"""Breakers and token buckets as streams: state for each provider, timers for what happens without a call."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import limits

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(calls: DataFrame, lateness: str) -> DataFrame:
    """Calls with an event time from their seconds ``at``, grouped by provider; state with timers needs the RocksDB store."""
    if not calls.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")
    return calls.withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).withWatermark("ts", lateness)


def _in_order(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(order, kind="stable")


class _Breaker(StatefulProcessor):
    """After the recovery an open breaker is half open, by a timer; a closed one without failures needs no state."""

    def __init__(self, threshold: int, recovery: float, order: list[str]):
        self.threshold, self.recovery, self.order = threshold, recovery, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("breaker", "state string, failures int, last double")

    def _row(self, key: tuple, name: str, failures: int, rejected: int) -> pd.DataFrame:
        return pd.DataFrame({"provider": [key[0]], "state": [name], "failures": [failures], "rejected": [rejected]})

    def _recovered(self, last: float) -> int:
        return int(1000 * (last + self.recovery)) + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.held.get() if self.held.exists() else None
        state = (0, *before) if before else limits.BREAKER
        for row in _in_order(rows, self.order).itertuples():
            state = limits.breaker_next(state, row.at, bool(row.ok), self.threshold, self.recovery)
        rejected, name, failures, last = state
        if before and before[0] == "OPEN" and (name, last) != (before[0], before[2]):
            self.handle.deleteTimer(self._recovered(before[2]))
        if name == "OPEN":
            if not before or before[0] != "OPEN" or before[2] != last:
                self.handle.registerTimer(self._recovered(last))
        if name == "CLOSED" and not failures:
            self.held.clear()
        else:
            self.held.update((name, failures, last))
        yield self._row(key, name, failures, rejected)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            name, failures, _ = self.held.get()
            if name == "OPEN":
                yield self._row(key, "HALF_OPEN", failures, 0)

    def close(self) -> None:
        pass


def breaker_stream(calls: DataFrame, threshold: int = 10, recovery: float = 30.0, order: str | None = None, lateness: str = "0 seconds") -> DataFrame:
    """(provider, state, failures, rejected) after each batch of calls (provider, at, ok), times in seconds, and when one is half open.

    rejected: calls rejected in this batch, so their sum is that of all. A provider's calls come in order from batch to batch; within
    one they are put in order by ``at`` and ``order``. Event time moves the timers: an open breaker of which nothing more is heard turns
    HALF_OPEN as soon as other calls show that the recovery has passed, and the next call that fails opens it at once.
    """
    columns = ["at", order] if order else ["at"]
    rows = _keyed(calls.select("provider", *columns, "ok"), lateness)
    return rows.groupBy("provider").transformWithStateInPandas(_Breaker(threshold, recovery, columns), "provider string, state string, failures int, rejected int", "Update", "EventTime")


class _Bucket(StatefulProcessor):
    """Once a bucket has had the time to fill up again, a timer drops its state: it starts full."""

    def __init__(self, fill: float, capacity: float, order: list[str]):
        self.fill, self.capacity, self.order = fill, capacity, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("bucket", "tokens double, last double")

    def _full(self, last: float) -> int:
        return int(1000 * (last + self.capacity / self.fill)) + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = limits.bucket_start(self.capacity)
        if self.held.exists():
            state = (0, 0.0, *self.held.get())
            self.handle.deleteTimer(self._full(state[3]))
        for row in _in_order(rows, self.order).itertuples():
            state = limits.bucket_next(state, row.at, self.fill, self.capacity)
        delayed, waited, tokens, last = state
        self.held.update((tokens, last))
        self.handle.registerTimer(self._full(last))
        yield pd.DataFrame({"provider": [key[0]], "delayed": [int(delayed)], "waited": [waited], "tokens": [tokens]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists() and self._full(self.held.get()[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
            yield pd.DataFrame({"provider": [key[0]], "delayed": [0], "waited": [0.0], "tokens": [self.capacity]})

    def close(self) -> None:
        pass


def bucket_stream(calls: DataFrame, fill: float, capacity: float, order: str | None = None, lateness: str = "0 seconds") -> DataFrame:
    """(provider, delayed, waited, tokens) after each batch of calls (provider, at), and when an idle bucket is full again.

    delayed, waited: of this batch, so their sums are those of all calls. Calls come as for breaker_stream.
    """
    columns = ["at", order] if order else ["at"]
    rows = _keyed(calls.select("provider", *columns), lateness)
    return rows.groupBy("provider").transformWithStateInPandas(_Bucket(fill, capacity, columns), "provider string, delayed int, waited double, tokens double", "Update", "EventTime")
