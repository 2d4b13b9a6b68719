"""Signs of life of slow calls: a stream of started and finished calls, and timers for those still open.

A call's start sets a timer of processing time; when it goes off and the call has not ended, the call is
reported as waiting, with the time gone by, and the timer set again. Nothing waits in a thread: the state
of all open calls is in the state store, by call, so that a restarted query goes on reporting them.

The session's state store must be RocksDB (`spark.sql.streaming.stateStore.providerClass`), as timers need
it. Defined cases: a second start of an open call changes nothing; an end without a start is reported as
done with no time gone by; an end that comes in the same batch as its start, in any order of rows, ends it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "call string, event string, message string, elapsed_ms bigint"


def shown(milliseconds: int) -> str:
    """Time gone by, in whole hours, minutes and seconds."""
    minutes, seconds = divmod(max(milliseconds, 0) // 1000, 60)
    hours, minutes = divmod(minutes, 60)
    return f"{hours}h {minutes}m {seconds}s" if hours else f"{minutes}m {seconds}s" if minutes else f"{seconds}s"


class Heartbeat(StatefulProcessor):
    def __init__(self, every_ms: int):
        self.every_ms = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "label string, started bigint")

    def _told(self, key, event: str, message: str, elapsed: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], event, message, elapsed)], columns=["call", "event", "message", "elapsed_ms"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        seen = pd.concat(list(rows))
        started, ended = seen[seen["event"] == "started"], seen[seen["event"] != "started"]
        if len(started) and not self.open.exists():
            self.open.update((str(started["label"].iloc[0]), now))
            self.handle.registerTimer(now + self.every_ms)
        if len(ended):
            label, began = self.open.get() if self.open.exists() else (str(ended["label"].iloc[0]), now)
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.open.clear()
            yield self._told(key, str(ended["event"].iloc[0]), f"{label} after {shown(now - began)}", now - began)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.open.exists():
            label, began = self.open.get()
            now = timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + self.every_ms)
            yield self._told(key, "waiting", f"Model still working on {label} ({shown(now - began)} elapsed)", now - began)

    def close(self) -> None:
        pass


def heartbeats(calls: DataFrame, every_ms: int = 1000) -> DataFrame:
    """(call, event, message, elapsed_ms): the ends of calls, and signs of those that are open.

    `calls` is a stream of (call, event, label), where the event is started, or how the call ended.
    """
    return calls.select("call", "event", "label").groupBy("call").transformWithStateInPandas(
        Heartbeat(every_ms), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime"
    )
