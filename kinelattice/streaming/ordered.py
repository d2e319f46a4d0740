"""Streaming metrics over frames that arrive late and out of order.

Frames wait in the state of their series until the watermark has passed their time, then they are judged in order, so
the answers do not depend on the order of arrival or on the cut into micro-batches; they are those of the batch window.
Frames later than the watermark allows are dropped by Spark. A timer at the earliest waiting frame releases it; one
``idle`` after the last frame drops the state of a series.

The state store must be RocksDB's (``spark.sql.streaming.stateStore.providerClass``), as timers and lists need it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kinelattice.streaming.jumps import OUT

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(ts: dt.datetime) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class OrderedJumps(StatefulProcessor):
    """Movement into each frame and whether it passes ``limit``; the buffer holds frames that the watermark has not passed."""

    def __init__(self, limit: float, idle_ms: int):
        self.limit, self.idle_ms = limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, frame int, x double, y double, z double")
        self.last = handle.getValueState("last", "at long, x double, y double, z double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows), ignore_index=True)
        self.waiting.appendList([(_ms(r.ts), int(r.frame), *(None if pd.isna(c) else float(c) for c in (r.x, r.y, r.z))) for r in fresh.itertuples()])
        yield from self._release(key, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues)

    def _release(self, key: tuple, timers) -> Iterator[pd.DataFrame]:
        """Judge the frames whose time the watermark has passed, keep the others, and set the timers."""
        now = timers.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = self.last.get() if self.last.exists() else None
        if ready:
            before = None if last is None else [np.nan if c is None else c for c in last[1:]]
            xyz = np.array([[np.nan if c is None else c for c in r[2:]] for r in ready], float)
            moved = np.sqrt(((xyz - np.vstack([np.full(3, np.nan) if before is None else before, xyz[:-1]])) ** 2).sum(1))
            jump = pd.Series(moved > self.limit, dtype="object")
            if before is None:
                jump.iloc[0] = None
            last = (ready[-1][0], *ready[-1][2:])
            self.last.update(last)
            yield pd.DataFrame({"series": key[0], "frame": [r[1] for r in ready], "moved": moved, "jump": jump.to_numpy()})
        if ready or not later:
            self.waiting.clear()
            if later and ready:
                self.waiting.put(later)
        if later:
            self.handle.registerTimer(later[0][0])
        elif last is not None and last[0] + self.idle_ms <= now:
            self.last.clear()
        elif last is not None:
            self.handle.registerTimer(last[0] + self.idle_ms)

    def close(self) -> None:
        pass


def ordered_jumps(frames: DataFrame, limit: float, delay: str = "10 seconds", idle_seconds: float = 3600.0) -> DataFrame:
    """series, frame, moved, jump over a stream of (series, ts, frame, x, y, z) in any order.

    ``ts`` is a frame's time; within a series frames and times grow together. Frames may be late by ``delay``. A series
    that is silent for ``idle_seconds`` starts anew. A missing coordinate is no jump; the first frame has no movement.
    """
    processor = OrderedJumps(limit, int(idle_seconds * 1000))
    return frames.withWatermark("ts", delay).groupBy("series").transformWithStateInPandas(processor, OUT, "append", "EventTime")
