"""Alignment of predictions with ground truth, and the filters in front of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("session", "sequence", "dim", "person", "camera", "frame")
#: Arrays of each component that evaluation reads (fixed values).
ARRAYS = {
    "body_joints": ("3d", "2d_interpolated"),
    "hand_joints": ("3d", "2d_interpolated"),
    "face_landmarks": ("3d", "2d_interpolated"),
    "gaze_interaction": ("gaze_look_at_3d", "gaze_mutual_3d"),
}


def frame_range(start: int, length: int, frame: str = "frame") -> Column:
    """Frames of a video part; length -1 has no upper bound. Pushed to the scan."""
    lower = F.col(frame) >= start
    return lower if length < 0 else lower & (F.col(frame) < start + length)


def allowed_arrays(df: DataFrame, allowed: dict[str, tuple[str, ...]] = ARRAYS) -> DataFrame:
    """Rows of the arrays that their component may have; a filter on partition columns."""
    keep = F.lit(False)
    for component, arrays in allowed.items():
        keep = keep | ((F.col("component") == component) & F.col("array_name").isin(*arrays))
    return df.filter(keep)


def rename_labels(df: DataFrame, synonyms: DataFrame, column: str = "label") -> DataFrame:
    """Labels replaced by their synonym where ``synonyms`` (old, new) has one."""
    joined = df.join(synonyms.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left")
    return joined.withColumn(column, F.coalesce("_new", column)).drop("_new").select(*df.columns)


def align(pred: DataFrame, gt: DataFrame, keys: list[str], labels: str | None = None, values: str = "v", how: str = "left") -> DataFrame:
    """Predictions with their ground truth: columns keys, v_pred, v_gt. Frames without truth stay with NULL.

    Labels match by name, frames by number, so only what both sides have is compared and no row depends on batches.
    """
    on = [*keys, *([labels] if labels else [])]
    return pred.select(*on, F.col(values).alias("v_pred")).join(gt.select(*on, F.col(values).alias("v_gt")), on, how)


def common_labels(pred_dims: DataFrame, gt_dims: DataFrame) -> DataFrame:
    """(label, pred_pos, gt_pos) in prediction order, from axis tables (label, pos)."""
    p, g = pred_dims.select("label", F.col("pos").alias("pred_pos")), gt_dims.select("label", F.col("pos").alias("gt_pos"))
    return p.join(g, "label")


def reconcile(pred_labels: list[str] | None, gt_labels: list[str] | None) -> tuple[list[int], list[int]] | None:
    """Positions of the common labels on both sides, in prediction order.

    None where neither side has the axis (nothing to reconcile); ValueError without a common label.
    """
    if pred_labels is None and gt_labels is None:
        return None
    at = {x: k for k, x in enumerate(gt_labels or [])}
    both = [(k, at[x]) for k, x in enumerate(pred_labels or []) if x in at]
    if not both:
        raise ValueError(f"no common labels in {pred_labels} and {gt_labels}")
    return [p for p, _ in both], [g for _, g in both]


def truth_key(session: str, sequence: str | None, dim: str) -> str:
    return "__".join(x for x in (session, sequence, dim) if x)


def split_truth_key(key: Column) -> tuple[Column, Column, Column]:
    """session, sequence (NULL if absent), dim of a truth key."""
    parts = F.split(key, "__")
    n = F.size(parts)
    return F.element_at(parts, 1), F.when(n > 2, F.element_at(parts, 2)), F.element_at(parts, -1)


def subset_axis4(v: Column, positions: list[int]) -> Column:
    return F.array(*(F.element_at(v, k + 1) for k in positions))


def labels_containing(df: DataFrame, part: str, label: str = "label") -> DataFrame:
    """Rows whose label has ``part`` in it."""
    return df.filter(F.col(label).contains(part))


def evaluation_entries(wanted: DataFrame, algorithms: dict[str, list[str]]) -> DataFrame:
    """(dataset, component, algorithm): ``wanted`` (dataset, component) with the algorithms of each component.

    Components without an algorithm have no entry.
    """
    mapping = wanted.sparkSession.createDataFrame([(c, a) for c, own in algorithms.items() for a in own], "component string, algorithm string")
    return wanted.select("dataset", "component").distinct().join(mapping, "component").select("dataset", "component", "algorithm")
