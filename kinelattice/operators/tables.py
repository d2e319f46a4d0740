"""Table shapes: dense grids, wide exports, axis tables, skeletons, regression differences, quality counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_grid(values: DataFrame, axes: dict[str, DataFrame], value: str = "value") -> DataFrame:
    """Every combination of the axes' rows with its value, NULL where there is none.

    For export only; the axes are small distinct tables, the long table stays sparse.
    """
    grid = reduce(lambda a, b: a.crossJoin(b), (df.select(c).distinct() for c, df in axes.items()))
    return grid.join(values.select(*axes, value), list(axes), "left")


def wide_names(label: str | None, coord: str | None, pos: int, same: bool) -> str:
    """Column name of a wide export: label, label_coord, or label_pos where all labels are alike."""
    base = f"{label}_{pos}" if same else str(label)
    return f"{base}_{coord}" if coord else base


def wide_export(long: DataFrame, keys: list[str], column: str, names: list[str], value: str = "value") -> DataFrame:
    """One row per keys, one column per name; the names are given, so no extra pass looks for them."""
    return long.groupBy(*keys).pivot(column, names).agg(F.first(value))


def dense_position(frame: str, keys: list[str]) -> Column:
    """Position of a frame in its array, from 0."""
    return F.dense_rank().over(Window.partitionBy(*keys).orderBy(frame)) - 1


def explode_axis(df: DataFrame, v: str, axis: DataFrame) -> DataFrame:
    """Packed arrays to rows: adds pos and label from an axis table (pos, label)."""
    out = df.select("*", F.posexplode(v).alias("pos", "value"))
    return out.join(axis.select("pos", "label"), "pos") if axis is not None else out


def keypoint_names(groups: dict[str, int | list[int] | dict]) -> dict[int, str]:
    """Index to name: a single index has its key, a list ``key_i``; groups may be nested."""
    out: dict[int, str] = {}
    for name, at in groups.items():
        if isinstance(at, dict):
            out |= keypoint_names(at)
        elif isinstance(at, (list, tuple)):
            out |= {int(k): f"{name}_{i}" for i, k in enumerate(at)}
        else:
            out[int(at)] = name
    return out


def polyline_edges(lines: DataFrame, line: str = "line", joints: str = "joints") -> DataFrame:
    """(line, start, end): consecutive joints of each polyline."""
    shifted = F.slice(joints, F.lit(2), F.greatest(F.size(joints) - 1, F.lit(0)))
    ends = F.filter(F.arrays_zip(F.col(joints).alias("start"), shifted.alias("end")), lambda e: e["end"].isNotNull())
    return lines.select(line, F.explode(ends).alias("e")).select(line, F.col("e.start").alias("start"), F.col("e.end").alias("end"))


def edge_points(points: DataFrame, edges: DataFrame, keys: list[str], coords: list[str], label: str = "label") -> DataFrame:
    """keys, line, start, end and the coordinates of both ends of every edge."""
    side = lambda s, name: points.select(*keys, F.col(label).alias(name), *(F.col(c).alias(f"{c}_{s}") for c in coords))
    return side("a", "start").join(edges, "start").join(side("b", "end"), [*keys, "end"])


def regression_diff(ours: DataFrame, golden: DataFrame, keys: list[str], value: str, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """One row: max_abs, mean_abs, std_diff (population), different, only_ours, only_golden. NULL equals NULL."""
    a, b = ours.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_in_a")), golden.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    both = a.join(b, keys, "full_outer")
    d = F.col("_a") - F.col("_b")
    inside = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    close = F.coalesce(F.abs(d) <= atol + rtol * F.abs(F.col("_b")), F.col("_a").isNull() & F.col("_b").isNull())
    return both.agg(
        F.max(F.abs(d)).alias("max_abs"), F.avg(F.abs(d)).alias("mean_abs"), F.stddev_pop(d).alias("std_diff"),
        F.count_if(inside & ~close).alias("different"), F.count_if(F.col("_in_b").isNull()).alias("only_ours"), F.count_if(F.col("_in_a").isNull()).alias("only_golden"),
    )


def missing_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).join(right.select(*keys), keys, "left_anti")


def zero_vectors(df: DataFrame, v: str) -> DataFrame:
    """One row: n and the number of vectors whose coordinates are all 0."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.forall(v, lambda x: x == 0)).alias("zero"))


def drop_last(df: DataFrame, order: str) -> DataFrame:
    """All rows but the last by ``order`` (unique): one aggregate, no global window."""
    last = df.agg(F.max(order).alias("_last"))
    return df.join(F.broadcast(last), F.col(order) < F.col("_last")).drop("_last")


def work_total(parts: DataFrame, length: str, keys: list[str] | None = None) -> DataFrame:
    """keys, frames: the frames of all parts together."""
    return parts.groupBy(*(keys or [])).agg(F.coalesce(F.sum(length), F.lit(0)).cast("bigint").alias("frames"))
