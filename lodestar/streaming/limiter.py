"""A sliding-window limiter per client: of the calls in time order, one is allowed while fewer than ``limit`` allowed ones
lie in the last 60 seconds. Refused calls do not count, so this is no window aggregate: it needs the state of each client."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOW_S = 60.0
SCHEMA = "client string, call_id long, at double, allowed boolean"


class Limiter:
    """State of one client: the times of its allowed calls in the window, at most ``limit`` of them."""

    def __init__(self, limit: int, times: list[float] = (), window: float = WINDOW_S):
        self.limit, self.window, self.times = max(0, int(limit)), window, deque(times)

    def allow(self, now: float) -> bool:
        if self.limit <= 0:
            return True
        while self.times and self.times[0] < now - self.window:
            self.times.popleft()
        if len(self.times) >= self.limit:
            return False
        self.times.append(now)
        return True


def limited(calls: DataFrame, limit: int, window: float = WINDOW_S) -> DataFrame:
    """(client, call_id, at, allowed) of calls (client, call_id, at in seconds), ties by call_id.

    Calls are sorted by client and time and streamed past one limiter, so a client of any number of calls needs only
    the memory of its window.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, state = None, Limiter(limit, window=window)
        for f in frames:
            out = []
            for client, at in zip(f["client"], f["at"], strict=True):
                if client != who:
                    who, state = client, Limiter(limit, window=window)
                out.append(state.allow(at))
            yield f.assign(allowed=out)[["client", "call_id", "at", "allowed"]]

    rows = calls.select(F.col("client").cast("string").alias("client"), F.col("call_id").cast("long").alias("call_id"), F.col("at").cast("double").alias("at"))
    return rows.repartition("client").sortWithinPartitions("client", "at", "call_id").mapInPandas(run, SCHEMA)


class _Stateful(StatefulProcessor):
    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = Limiter(self.limit, [t[0] for t in self.times.get()], self.window)
        calls = pd.concat(list(rows)).sort_values(["at", "call_id"])
        calls = calls.assign(allowed=[state.allow(t) for t in calls["at"]])
        self.times.clear()
        if state.times:
            self.times.put([(t,) for t in state.times])
        yield calls[["client", "call_id", "at", "allowed"]]

    def close(self) -> None:
        pass


def limited_stream(calls: DataFrame, limit: int, window: float = WINDOW_S) -> DataFrame:
    """The same on a stream (client, call_id, at): the window of each client is kept in the state store."""
    rows = calls.select(F.col("client").cast("string").alias("client"), F.col("call_id").cast("long").alias("call_id"), F.col("at").cast("double").alias("at"))
    return rows.groupBy("client").transformWithStateInPandas(_Stateful(limit, window), SCHEMA, "Append", "None")
