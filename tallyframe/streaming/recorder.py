"""Recorder sessions over a stream: a session is open while its frames keep coming, and an event-time timer stops it once it has been silent for long enough."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers need; a stream's session has to be set to it before it starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "session_id string, started long, stopped long, frames long, closed_by string"


class Recorder(StatefulProcessor):
    """Keeps the open runs of a session (first and last moment in milliseconds, frames), of which there is one unless frames come out of order. Rows
    arrive in frames of bounded size and are folded into the runs one frame after the other, so a session's batch is never held whole."""

    def __init__(self, silence: int):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "first long, last long, frames long")

    def _folded(self, runs: list[tuple], moments: np.ndarray) -> list[tuple]:
        """Runs of which no two are within the silence of each other."""
        at = np.sort(moments)
        cuts = np.flatnonzero(np.diff(at) >= self.silence) + 1
        runs = sorted(runs + [(int(x[0]), int(x[-1]), len(x)) for x in np.split(at, cuts) if len(x)])
        out: list[tuple] = []
        for first, last, n in runs:
            if out and first - out[-1][1] < self.silence:
                out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
            else:
                out.append((first, last, n))
        return out

    def _closed(self, key: tuple, runs: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], first, last, n, "silence") for first, last, n in runs], columns=[c.split()[0] for c in OUT.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.runs.exists()
        runs = [tuple(r) for r in self.runs.get()] if known else []
        for part in rows:
            runs = self._folded(runs, part["at"].to_numpy(np.int64))
        if known:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        self._wait(runs, timerValues)
        self.runs.put(runs)
        yield self._closed(key, [])

    def _wait(self, runs: list[tuple], timerValues) -> None:
        """One timer for a session, for the first of its runs that will have been silent: calls to the state are what a session costs."""
        if runs:
            self.handle.registerTimer(max(min(last for _, last, _ in runs) + self.silence, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Closes all runs that have been silent by the watermark, not only the one that the timer was for."""
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) - self.silence
        runs = [tuple(r) for r in self.runs.get()] if self.runs.exists() else []
        done, left = [r for r in runs if r[1] <= until], [r for r in runs if r[1] > until]
        if left:
            self.runs.put(left)
            self._wait(left, timerValues)
        elif runs:
            self.runs.clear()
        yield self._closed(key, done)

    def close(self) -> None:
        pass


def sessions(frames: DataFrame, silence: str, late: str = "1 hour") -> DataFrame:
    """(session_id, started, stopped (milliseconds), frames, closed_by) of a stream of (session_id, ts): a row for each run of frames, when a timer finds that none has come
    for so long. Frames later than `late` behind the newest are dropped; runs that are still open are not told yet. Rows without a session or a time are left out."""
    ms = int(pd.Timedelta(silence).total_seconds() * 1000)
    rows = frames.withColumn("ts", F.col("ts").cast("timestamp")).where("session_id is not null and ts is not null").withWatermark("ts", late)
    timed = rows.select(F.col("session_id").cast("string").alias("session_id"), "ts", F.unix_millis("ts").alias("at"))
    return timed.groupBy("session_id").transformWithStateInPandas(Recorder(ms), outputStructType=OUT, outputMode="append", timeMode="eventTime")
