"""Sessions that expire by the clock: a stateful operator with processing-time timers.

`session_window` closes a session when a later event moves the watermark. Here a session ends `ttl` after its last event by the clock of the cluster, though no event
ever follows. State is a row per open session, in the state store; a session's timer is moved with each of its events.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers need; to be set on the session before the query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATE = "first timestamp, last timestamp, n_events bigint"


class Inactivity(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = last = None
        n = 0
        for r in rows:
            first = r.ts if first is None else min(first, r.ts)
            last = r.ts if last is None else max(last, r.ts)
            n += 1
        if self.session.exists():
            before = self.session.get()
            first, last, n = min(first, before[0]), max(last, before[1]), n + before[2]
        self.session.update((first, last, n))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first, last, n = self.session.get()
        self.session.clear()
        yield Row(key=key[0], first=first, last=last, n_events=n)

    def close(self) -> None:
        pass


def expired_sessions(events: DataFrame, key: str, ts: str, ttl_ms: int) -> DataFrame:
    """A stream of (key, first, last, n_events) of sessions without an event for `ttl_ms` of processing time. Events without a key or time are no activity."""
    kind = dict(events.dtypes)[key]
    d = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts")).where("key is not null and ts is not null")
    return d.groupBy("key").transformWithState(Inactivity(ttl_ms), f"key {kind}, {STATE}", "append", "processingTime")
