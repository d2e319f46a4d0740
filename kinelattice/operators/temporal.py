"""Temporal operators over frame series: one window per series key, ordered by frame.

Columns are scalars (one per coordinate), so everything stays in generated code and the operators on one series share a
sort. ``lag`` means the previous row; with ``gaps="frame"`` only the frame directly before counts.

By default a series is one window partition. With ``block``, a number of frames, the operators work on blocks of a series
(:func:`blockwise`), so one long series is spread over all tasks; the rows are the same.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelattice.functions.vec import dot, strict_least


def series(keys: list[str], order: str = "frame"):
    return Window.partitionBy(*keys).orderBy(order)


def blockwise(df: DataFrame, keys: list[str], order: str, block: int, op: Callable[[DataFrame, list[str]], DataFrame], before: int = 0, after: int = 0, last: Column | None = None, first: Column | None = None) -> DataFrame:
    """``op`` (rows, keys) on blocks of ``block`` frames with what it needs from other blocks beside them.

    ``before`` and ``after`` rows of the neighbouring blocks stand beside a block (a fixed window), or the ``last`` row before
    it and the ``first`` one behind it for which a condition holds (a scan). Each block gives its edge rows once; a window
    over a series' *blocks* passes them on, however many blocks lie between; then the operator's own windows have one
    partition per block. Its results for the rows of other blocks are dropped.
    """
    kept = df.columns
    own = df.withColumn("_block", F.floor(F.col(order) / block))
    row = F.struct(F.col(order).alias("_at"), F.struct(*kept).alias("_row"))
    of = lambda n, every: F.slice(every, F.lit(1), F.lit(n)) if n > 0 else F.slice(every, F.greatest(F.size(every) + n, F.lit(0)) + 1, F.lit(-n))
    every = F.array_sort(F.collect_list(row))  # a block's rows
    parts = {
        "_tail": F.array(F.max_by(row, F.col(order))) if before == 1 else of(-before, every) if before else None,
        "_head": F.array(F.min_by(row, F.col(order))) if after == 1 else of(after, every) if after else None,
        "_last": None if last is None else F.max_by(F.when(last, row), F.when(last, F.col(order))),
        "_first": None if first is None else F.min_by(F.when(first, row), F.when(first, F.col(order))),
    }
    blocks = own.groupBy(*keys, "_block").agg(*(c.alias(n) for n, c in parts.items() if c is not None))
    up = Window.partitionBy(*keys).orderBy("_block")
    down = Window.partitionBy(*keys).orderBy(F.col("_block").desc())  # what follows, as what comes before in the other order
    halo = {
        "_tail": lambda: of(-before, F.flatten(F.collect_list("_tail").over(up.rowsBetween(-before, -1)))),
        "_head": lambda: of(after, F.flatten(F.collect_list("_head").over(up.rowsBetween(1, after)))),
        "_last": lambda: F.array(F.last("_last", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1))),
        "_first": lambda: F.array(F.last("_first", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))),
    }
    names = [n for n, c in parts.items() if c is not None]
    beside = blocks.select("_block", *(halo[n]().alias(n) for n in names)).select("_block", F.explode(F.concat(*names)).alias("_r")).filter("_r is not null")
    beside = beside.select(*(F.col(f"_r._row.`{c}`").alias(c) for c in kept), "_block", F.lit(False).alias("_own"))
    return op(own.withColumn("_own", F.lit(True)).unionByName(beside), [*keys, "_block"]).filter("_own").drop("_own", "_block")


def previous(column: str, keys: list[str], order: str = "frame", gaps: str = "row") -> Column:
    value = F.lag(column).over(series(keys, order))
    return F.when(F.lag(order).over(series(keys, order)) == F.col(order) - 1, value) if gaps == "frame" else value


def displacement(df: DataFrame, keys: list[str], coords: list[str], order: str = "frame", gaps: str = "row", block: int | None = None) -> DataFrame:
    """d_<coord> for each coordinate; NULL in the first frame."""
    if block:
        return blockwise(df, keys, order, block, lambda d, k: displacement(d, k, coords, order, gaps), before=1)
    return df.withColumns({f"d_{c}": F.col(c) - previous(c, keys, order, gaps) for c in coords})


def _length(coords: list[str]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, (F.col(f"d_{c}") * F.col(f"d_{c}") for c in coords)))


def velocity(df: DataFrame, keys: list[str], coords: list[str], fps: float, conf: str | None = None, order: str = "frame", gaps: str = "row", block: int | None = None) -> DataFrame:
    """Adds d_<coord>, velocity (units per second) and, with ``conf``, the least confidence of both frames."""
    if block:
        return blockwise(df, keys, order, block, lambda d, k: velocity(d, k, coords, fps, conf, order, gaps), before=1)
    out = displacement(df, keys, coords, order, gaps).withColumn("velocity", _length(coords) * F.lit(float(fps)))
    return out if conf is None else out.withColumn("min_conf", strict_least(F.col(conf), previous(conf, keys, order, gaps)))


def jump_flags(df: DataFrame, keys: list[str], coords: list[str], limits: DataFrame, label: str, limit: str, unit: float = 1000.0, order: str = "frame", block: int | None = None) -> DataFrame:
    """Adds jump: the movement into this frame is longer than its label's limit times ``unit`` (metres to millimetres).

    Labels without a limit never jump; a missing coordinate is no jump; the first frame of a series is NULL. ``limits``
    is a metadata table with one row per label.
    """
    if block:
        return blockwise(df, keys, order, block, lambda d, k: jump_flags(d, k, coords, limits, label, limit, unit, order), before=1)
    moved = displacement(df, keys, coords, order)
    joined = moved.join(limits.select(F.col(label), F.col(limit).alias("_limit")), label, "left")
    far = F.col("_limit").isNotNull() & (_length(coords) > F.col("_limit") * unit)
    first = F.row_number().over(series(keys, order)) == 1
    return joined.withColumn("jump", F.when(~first, F.coalesce(far, F.lit(False)))).drop("_limit", *(f"d_{c}" for c in coords))


def gradient(df: DataFrame, keys: list[str], column: str, order: str = "frame", block: int | None = None) -> DataFrame:
    """Adds gradient: central differences, one-sided at both ends of the series, unit spacing. Ends are row positions."""
    if block:
        return blockwise(df, keys, order, block, lambda d, k: gradient(d, k, column, order), before=1, after=1)
    w = series(keys, order)
    at, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(*keys))
    before, after = F.lag(column).over(w), F.lead(column).over(w)
    x = F.col(column)
    return df.withColumn("gradient", F.when(n < 2, F.lit(None).cast("double")).when(at == 1, after - x).when(at == n, x - before).otherwise((after - before) / 2))


def savgol_matrix(window: int, order: int) -> np.ndarray:
    """Row j: weights of a window's values in the value at j of the polynomial fitted to them."""
    t = np.arange(window) - window // 2
    basis = np.vander(t, order + 1, increasing=True).astype(float)
    return basis @ np.linalg.pinv(basis)


def savgol(df: DataFrame, keys: list[str], column: str, window: int = 11, order: int = 2, frame: str = "frame", block: int | None = None) -> DataFrame:
    """Adds smoothed: Savitzky-Golay. At the ends the polynomial of the first and last window is used.

    A NULL spreads over the windows that hold it. A series shorter than the window is an error.
    """
    if window % 2 == 0 or order >= window:
        raise ValueError("the window must be odd and longer than the order")
    if block:
        return blockwise(df, keys, frame, block, lambda d, k: savgol(d, k, column, window, order, frame), before=window - 1, after=window - 1)
    w, half = series(keys, frame), window // 2
    at, n, x = F.row_number().over(w) - 1, F.count(F.lit(1)).over(Window.partitionBy(*keys)), F.col(column).cast("double")
    near = [x if k == 0 else F.lag(x, -k).over(w) if k < 0 else F.lead(x, k).over(w) for k in range(-(window - 1), window)]
    out = df.withColumns({"_at": at, "_n": n, "_near": F.array(*near)})
    short = F.raise_error(F.lit(f"a series is shorter than the window of {window}")).cast("double")
    spot = F.col("_at") - F.greatest(F.lit(0), F.least(F.col("_at") - half, F.col("_n").cast("int") - window))  # this row's place in its window
    weights = F.array(*(F.array(*(F.lit(float(c)) for c in row)) for row in savgol_matrix(window, order)))
    fitted = dot(F.slice("_near", window - spot, F.lit(window)), F.element_at(weights, spot + 1))
    return out.withColumn("smoothed", F.when(F.col("_n") < window, short).otherwise(fitted)).select(*df.columns, "smoothed")


def interpolate(df: DataFrame, keys: list[str], coords: list[str], max_empty: int = 10, order: str = "frame", compat: bool = False, block: int | None = None) -> DataFrame:
    """Fills gaps of up to ``max_empty`` steps linearly; what is missing is read from the first coordinate.

    Values before the first and after the last observation stay missing. With ``compat``, long gaps are handled by the
    literal rule of the older tool: the observation before a long gap is dropped and the line drawn across it.
    """
    observed = F.col(coords[0]).isNotNull()
    if not compat:
        fill = lambda d, k: _fill(d.withColumn("_ok", observed), k, coords, order, max_empty)
        return blockwise(df, keys, order, block, fill, last=observed, first=observed) if block else fill(df, keys)
    judge = partial(_before_short_gap, coords=coords, order=order, max_empty=max_empty)
    judged = blockwise(df, keys, order, block, judge, first=observed) if block else judge(df, keys)
    fill = lambda d, k: _fill(d, k, coords, order, None)
    return blockwise(judged, keys, order, block, fill, last=F.col("_ok"), first=F.col("_ok")) if block else fill(judged, keys)


def _before_short_gap(df: DataFrame, keys: list[str], coords: list[str], order: str, max_empty: int) -> DataFrame:
    """Adds _ok: an observation that is the last one or has the next one within ``max_empty`` steps."""
    seen = F.when(F.col(coords[0]).isNotNull(), F.col(order))
    later = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = F.last(seen, ignorenulls=True).over(later)
    return df.withColumn("_after", after).withColumn("_ok", F.coalesce(F.col(coords[0]).isNotNull() & (F.col("_after").isNull() | (F.col("_after") - F.col(order) <= max_empty)), F.lit(False))).drop("_after")


def _fill(df: DataFrame, keys: list[str], coords: list[str], order: str, most: int | None) -> DataFrame:
    """Lines between the rows that are _ok, over at most ``most`` steps. Both neighbours are the last ones of a scan, upwards and downwards."""
    df = df.withColumn("_seen", F.when(F.col("_ok"), F.struct(F.col(order).alias("t"), *(F.col(c) for c in coords))))
    scan = lambda by: F.last("_seen", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("_a", scan(F.col(order))).withColumn("_b", scan(F.col(order).desc()))
    inside = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    fits = inside if most is None else inside & (F.col("_b.t") - F.col("_a.t") <= most)
    share = F.try_divide(F.col(order) - F.col("_a.t"), F.col("_b.t") - F.col("_a.t"))
    line = lambda c: F.col(f"_a.{c}") + (F.col(f"_b.{c}") - F.col(f"_a.{c}")) * F.coalesce(share, F.lit(0.0))
    return df.withColumns({c: F.when(F.col("_ok"), F.col(c)).when(fits, line(c)).otherwise(F.col(c)) for c in coords}).drop("_ok", "_seen", "_a", "_b")


def carry_forward(df: DataFrame, keys: list[str], column: str, ok: Column, order: str = "frame", block: int | None = None) -> DataFrame:
    """Adds carried: the last value of a row where ``ok`` holds and the value is known, up to this row."""
    if block:
        good = F.coalesce(ok & F.col(column).isNotNull(), F.lit(False))
        return blockwise(df, keys, order, block, lambda d, k: carry_forward(d, k, column, ok, order), last=good)
    w = series(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("carried", F.last(F.when(ok, F.col(column)), ignorenulls=True).over(w))


def frame_time(frame: Column, fps: float) -> Column:
    return frame / F.lit(float(fps))


def real_frame(n: Column, start: int) -> Column:
    """Frame number of the n-th extracted image, n from 1."""
    return n + F.lit(start - 1)


def every_nth(df: DataFrame, step: int, start: int = 0, frame: str = "frame_idx") -> DataFrame:
    return df.filter((F.col(frame) - start) % step == 0)


def mask_low_confidence(df: DataFrame, coords: list[str], conf: str, least: float = 0.6) -> DataFrame:
    """Coordinates are missing where the confidence is below ``least``; an unknown confidence keeps them."""
    low = F.coalesce(F.col(conf) < least, F.lit(False))
    return df.withColumns({c: F.when(~low, F.col(c)) for c in coords})
