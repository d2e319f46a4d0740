"""Streaming metrics: state per series instead of a window over all frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "series string, frame int, moved double, jump boolean"


def jumps(frames: DataFrame, limit: float) -> DataFrame:
    """Movement into each frame and whether it passes ``limit``, over a stream of (series, frame, x, y, z).

    The last frame of a series is its state, so results do not depend on how the stream is cut into batches. Frames of
    a series must arrive in order; the first has no movement. A missing coordinate is no jump.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = np.array(state.get, float) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("frame")
        xyz = rows[["x", "y", "z"]].to_numpy(float)
        before = np.vstack([last if last is not None else np.full(3, np.nan), xyz[:-1]])
        moved = np.sqrt(((xyz - before) ** 2).sum(1))
        state.update(tuple(float(c) for c in xyz[-1]))
        jump = pd.Series(moved > limit, dtype="object")
        if last is None:
            jump.iloc[0] = None
        yield pd.DataFrame({"series": key[0], "frame": rows["frame"].to_numpy(), "moved": moved, "jump": jump.to_numpy()})

    return frames.groupBy("series").applyInPandasWithState(step, OUT, "x double, y double, z double", "append", GroupStateTimeout.NoTimeout)
