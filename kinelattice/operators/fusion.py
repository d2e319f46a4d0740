"""Fusion of gaze vectors over cameras and algorithms, body-part means, projection to camera views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelattice.functions.vec import matvec, pitch_yaw, pixel_vector, strict_mean, unit

#: Rows of a calibration table that is repeated for every vector.
MOST_CAMERAS = 1000


def fuse_mean(df: DataFrame, keys: list[str], coords: list[str], normalise: bool = True) -> DataFrame:
    """keys, fused: mean of every coordinate over what is there, at unit length."""
    out = df.groupBy(*keys).agg(F.array(*(F.avg(c) for c in coords)).alias("fused"))
    return out.withColumn("fused", unit(F.col("fused"))) if normalise else out


def fuse_weighted(df: DataFrame, keys: list[str], coords: list[str], weight: str, normalise: bool = True) -> DataFrame:
    """keys, fused: weighted mean. A missing weight or a vector with a missing coordinate weighs 0; no weight, no vector."""
    known = F.lit(True)
    for c in coords:
        known = known & F.col(c).isNotNull()
    w = F.coalesce(F.when(known, F.col(weight)), F.lit(0.0))
    mean = lambda c: F.try_divide(F.sum(F.coalesce(F.col(c), F.lit(0.0)) * w), F.sum(w))
    out = df.groupBy(*keys).agg(F.array(*(mean(c) for c in coords)).alias("fused"))
    return out.withColumn("fused", unit(F.col("fused"))) if normalise else out


def ensemble(inputs: list[DataFrame], keys: list[str], coords: list[str], weight: str | None = None) -> DataFrame:
    """Fusion over the cameras of all algorithms; a missing confidence column counts as 1."""
    columns = [*keys, *coords, *([weight] if weight else [])]
    rows = None
    for df in inputs:
        own = df if weight is None or weight in df.columns else df.withColumn(weight, F.lit(1.0))
        rows = own.select(*columns) if rows is None else rows.unionByName(own.select(*columns))
    return fuse_weighted(rows, keys, coords, weight) if weight else fuse_mean(rows, keys, coords)


def face_confidence(landmarks: DataFrame, keys: list[str], conf: str = "conf") -> DataFrame:
    return landmarks.groupBy(*keys).agg(F.avg(conf).alias("face_conf"))


def bodypart_means(df: DataFrame, keys: list[str], value: str, bodyparts: DataFrame, label: str = "label") -> DataFrame:
    """keys, bodypart, <value>: mean over the joints of each body part, missing ones left out.

    ``bodyparts`` (bodypart, label) is a small metadata table.
    """
    return df.join(bodyparts, label).groupBy(*keys, "bodypart").agg(F.avg(value).alias(value))


def argmax_label(df: DataFrame, keys: list[str], label: str, value: str, pos: str) -> DataFrame:
    """keys, <label> with the largest value; ties go to the lowest ``pos``."""
    return df.groupBy(*keys).agg(F.max_by(label, F.struct(F.col(value), -F.col(pos))).alias(label))


def eye_region(landmarks: DataFrame, keys: list[str], coords: list[str], pos: str = "pos", first: int = 4) -> DataFrame:
    """Mean of the first landmarks of a face, missing ones left out."""
    return landmarks.filter(F.col(pos) < first).groupBy(*keys).agg(*(F.avg(c).alias(c) for c in coords))


def project_gaze(gaze: DataFrame, cameras: DataFrame, keys: list[str], v: str = "fused", session: list[str] | None = None) -> DataFrame:
    """keys, camera, dx, dy: the gaze in every camera's image, stored negated.

    ``cameras`` (session, camera, R, image_width) is calibration. With ``session``, columns that both sides have, a vector
    meets its own session's cameras only, by a null-safe join. Without, ``cameras`` is one session's, repeated for every vector;
    more than ``MOST_CAMERAS`` rows make the query fail. A missing vector stays missing.
    """
    if session:
        known = cameras.select(*(F.col(c).alias(f"_s{k}") for k, c in enumerate(session)), "camera", "R", "image_width")
        same = reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.col(f"_s{k}")) for k, c in enumerate(session)))
        wide = gaze.select(*dict.fromkeys([*session, *keys]), v).join(known, same)
    else:
        held = cameras.select(F.struct("camera", "R", "image_width").alias("c")).limit(MOST_CAMERAS + 1).agg(F.collect_list("c").alias("all"))
        few = F.when(F.size("all") <= MOST_CAMERAS, F.col("all")).otherwise(F.raise_error(F.lit(f"a calibration of more than {MOST_CAMERAS} cameras")))
        wide = gaze.select(*keys, v).crossJoin(F.broadcast(held.select(few.alias("all")))).select(*keys, v, F.inline("all"))
    pitch, yaw = pitch_yaw(matvec(F.col("R"), F.col(v)))
    wide = wide.withColumns({"_pitch": pitch, "_yaw": yaw})
    known = F.col("_pitch").isNotNull() & F.col("_yaw").isNotNull()
    dx, dy = pixel_vector(F.when(known, F.col("_pitch")), F.when(known, F.col("_yaw")), F.col("image_width"))
    return wide.select(*dict.fromkeys([*(session or []), *keys]), "camera", (-dx).alias("dx"), (-dy).alias("dy"))


def display_arrow(v: Column) -> Column:
    """A 3-D gaze as drawn: negated and halved."""
    return F.transform(v, lambda x: -x / 2)


def mid_point(points: DataFrame, keys: list[str], coords: list[str], labels: list[str], label: str = "label") -> DataFrame:
    """keys and coords: the point between the named keypoints (eyes, say); missing if one of them is."""
    return points.filter(F.col(label).isin(*labels)).groupBy(*keys).agg(*(F.when(F.count(c) == len(labels), F.avg(c)).alias(c) for c in coords))


def time_mean(points: DataFrame, keys: list[str], coords: list[str]) -> DataFrame:
    """keys and coords: the mean point over all frames; missing if one of them is."""
    return points.groupBy(*keys).agg(*(strict_mean(F.col(c)).alias(c) for c in coords))


def face_centre(x: Column, y: Column, rank: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A face centre for display; where it is missing, a third or two thirds across the image for the first or second person."""
    return F.coalesce(x, width * (rank + 1) / 3), F.coalesce(y, height / 3)
