"""Calibration and camera geometry: Rodrigues, completion, undistortion, two-view triangulation, head axes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelattice.functions.vec import euler_matrix, inverse3, matvec, transpose3, unit
from kinelattice.session import importable

#: Names under which calibration files store the same matrices (fixed values).
SYNONYMS = {"K": ("K", "mtx"), "d": ("d", "dist", "distortion"), "t": ("t", "tvec"), "r": ("r", "rvec"), "R": ("R",)}


def rodrigues(r: np.ndarray) -> np.ndarray:
    """Rotation matrix of a rotation vector."""
    r = np.asarray(r, float).ravel()
    theta = np.linalg.norm(r)
    if theta < 1e-12:
        return np.eye(3)
    x, y, z = r / theta
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(theta) * k + (1 - np.cos(theta)) * (k @ k)


def rotation_vector(m: np.ndarray) -> np.ndarray:
    """Rotation vector of a rotation matrix."""
    m = np.asarray(m, float)
    angle = np.arccos(np.clip((np.trace(m) - 1) / 2, -1, 1))
    if angle < 1e-12:
        return np.zeros(3)
    if np.pi - angle < 1e-6:  # the axis from the symmetric part
        s = (m + np.eye(3)) / 2
        axis = s[:, np.argmax(np.diag(s))]
        return angle * axis / np.linalg.norm(axis)
    return angle / (2 * np.sin(angle)) * np.array([m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]])


def complete(camera: dict) -> dict:
    """A camera with K, d (5 values), R, r, t, Rt and P from what a file gives under any of the known names."""
    got = {name: np.asarray(camera[a], float) for name, aliases in SYNONYMS.items() for a in aliases if a in camera}
    if missing := {"K", "t"} - got.keys():
        raise KeyError(f"calibration lacks {sorted(missing)}")
    if "R" not in got and "r" not in got:
        raise KeyError("calibration lacks a rotation")
    rotation = got["R"] if "R" in got else rodrigues(got["r"])
    if rotation.shape == (3, 4):
        rotation = rotation[:, :3]
    if not np.allclose(rotation @ rotation.T, np.eye(3), atol=0.01):
        raise ValueError("R is no rotation")
    d = np.zeros(5)
    own = got.get("d", d).ravel()[:5]
    d[: len(own)] = own
    t = got["t"].reshape(3, 1)
    rt = np.hstack([rotation, t])
    return {"K": got["K"], "d": d, "R": rotation, "r": got["r"].ravel() if "r" in got else rotation_vector(rotation), "t": t.ravel(), "Rt": rt, "P": got["K"] @ rt}


def undistort(points: np.ndarray, k: np.ndarray, d: np.ndarray, steps: int = 20) -> np.ndarray:
    """Ideal pixel positions of distorted ones: fixed-point iteration of the Brown-Conrady model (k1, k2, p1, p2, k3).

    ``k`` and ``d`` are one camera's, or hold a camera for each point.
    """
    f, c = np.stack([k[..., 0, 0], k[..., 1, 1]], axis=-1), np.stack([k[..., 0, 2], k[..., 1, 2]], axis=-1)
    k1, k2, p1, p2, k3 = np.moveaxis(d, -1, 0)
    seen = (points - c) / f
    x = seen.copy()
    for _ in range(steps):
        r2 = (x * x).sum(1)
        radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
        xy = x[:, 0] * x[:, 1]
        tangential = np.column_stack([2 * p1 * xy + p2 * (r2 + 2 * x[:, 0] ** 2), p1 * (r2 + 2 * x[:, 1] ** 2) + 2 * p2 * xy])
        x = (seen - tangential) / radial[:, None]
    return x * f + c


def distorted(x: Column, y: Column, k: Column, d: Column) -> tuple[Column, Column]:
    """Where a camera with matrix ``k`` and distortion ``d`` sees the ideal pixel (x, y): the model that :func:`undistort` inverts."""
    at = lambda i, j: F.element_at(F.element_at(k, i), j)
    u, v = (x - at(1, 3)) / at(1, 1), (y - at(2, 3)) / at(2, 2)
    k1, k2, p1, p2, k3 = (F.element_at(d, i) for i in range(1, 6))
    r2 = u * u + v * v
    radial = F.lit(1.0) + r2 * (k1 + r2 * (k2 + r2 * k3))
    du = u * radial + F.lit(2.0) * p1 * u * v + p2 * (r2 + F.lit(2.0) * u * u)
    dv = v * radial + p1 * (r2 + F.lit(2.0) * v * v) + F.lit(2.0) * p2 * u * v
    return du * at(1, 1) + at(1, 3), dv * at(2, 2) + at(2, 3)


def triangulate(p1: np.ndarray, p2: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """3-D points from two views: for each the null vector of the four projection equations, scaled to w = 1.

    The projection matrices are those of one pair of cameras, or of a pair for each point.
    """
    line = lambda p, x, i: x[:, i : i + 1] * p[..., 2, :] - p[..., i, :]
    rows = np.stack([line(p1, a, 0), line(p1, a, 1), line(p2, b, 0), line(p2, b, 1)], axis=1)
    x = np.linalg.svd(rows)[2][:, -1]
    return x[:, :3] / x[:, 3:]


def camera_pairs(calibration: DataFrame, session: list[str], cameras: tuple[str, str] | None = None) -> DataFrame:
    """session, camera_a, camera_b and the K, dist and P of both, flat: the two named cameras, or the first two by name.

    Sessions without both cameras have no row.
    """
    own = F.struct("camera", F.flatten("K").alias("K"), F.col("dist"), F.flatten("P").alias("P"))
    if cameras:
        pick = [F.max(F.when(F.col("camera") == c, own)) for c in cameras]
        both = calibration.groupBy(*session).agg(*(c.alias(s) for c, s in zip(pick, "ab")))
    else:
        first = calibration.groupBy(*session).agg(F.slice(F.array_sort(F.collect_list(own)), 1, 2).alias("two"))  # a session's few cameras
        both = first.filter(F.size("two") == 2).select(*session, F.get("two", F.lit(0)).alias("a"), F.get("two", F.lit(1)).alias("b"))
    return both.filter("a is not null and b is not null").select(*session, *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("camera", "K", "dist", "P")))


_FLAT = {"K": (3, 3), "dist": (5,), "P": (3, 4)}


def triangulate_sessions(points: DataFrame, calibration: DataFrame, keys: list[str], session: list[str], cameras: tuple[str, str] | None = None) -> DataFrame:
    """session, keys, x, y, z, conf from 2-D points (session, keys, camera, x, y, conf), each under its own session's cameras.

    ``calibration`` has one row per session and camera (the columns of ``sources.calibration``). Both views of a point
    meet in one aggregation; a session's matrices join its rows, on null-safe session keys, and travel with them, so points of
    many sessions are solved in one batch. A view that is missing makes the point missing; the confidence is the lesser one.
    Points of sessions that lack a camera are left out.
    """
    importable(points.sparkSession)
    pairs = camera_pairs(calibration, session, cameras)
    pairs = pairs.select(*(F.col(c).alias(f"_s{k}") for k, c in enumerate(session)), *(c for c in pairs.columns if c not in session))
    same = reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.col(f"_s{k}")) for k, c in enumerate(session)))
    names = [F.lit(c) for c in cameras] if cameras else [F.col("camera_a"), F.col("camera_b")]
    seen = points if cameras else points.join(pairs.select(*(f"_s{k}" for k in range(len(session))), "camera_a", "camera_b"), same)
    view = F.struct(*(F.col(c).cast("double").alias(c) for c in ("x", "y", "conf")))
    both = seen.groupBy(*session, *keys).agg(*(F.max(F.when(F.col("camera") == n, view)).alias(s) for n, s in zip(names, "ab")))
    both = both.filter("a is not null and b is not null").join(pairs, same).select(*session, *keys, *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("x", "y", "conf")), *(f"{c}_{s}" for s in "ab" for c in _FLAT))
    fields = {f.name: f.dataType.simpleString() for f in both.schema}
    kept = [*session, *keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda c: np.asarray(batch.column(c).cast(pa.float64()).fill_null(np.nan))
            flat = lambda c, shape: np.asarray(batch.column(c).flatten()).reshape(-1, *shape)
            a, b = (np.column_stack([of(f"x_{s}"), of(f"y_{s}")]) for s in "ab")
            good = ~(np.isnan(a).any(1) | np.isnan(b).any(1))
            m = {f"{c}_{s}": flat(f"{c}_{s}", shape)[good] for s in "ab" for c, shape in _FLAT.items()}
            xyz = np.full((batch.num_rows, 3), np.nan)
            if good.any():
                xyz[good] = triangulate(m["P_a"], m["P_b"], undistort(a[good], m["K_a"], m["dist_a"]), undistort(b[good], m["K_b"], m["dist_b"]))
            least = np.minimum(of("conf_a"), of("conf_b"))
            least[~good] = np.nan
            values = [pa.array(c, pa.float64(), from_pandas=True) for c in (*xyz.T, least)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *values], [*kept, "x", "y", "z", "conf"])

    return both.mapInArrow(run, ", ".join(f"`{k}` {fields[k]}" for k in kept) + ", x double, y double, z double, conf double")


def triangulate_joints(points: DataFrame, first: dict, second: dict, cameras: tuple[str, str], keys: list[str]) -> DataFrame:
    """keys, x, y, z, conf from 2-D points (camera, x, y, conf) of one pair of calibrated cameras, used for the whole table."""
    rows = [(1, name, m["K"].tolist(), m["d"].tolist(), m["P"].tolist()) for name, m in zip(cameras, map(complete, (first, second)))]
    table = points.sparkSession.createDataFrame(rows, "_all int, camera string, K array<array<double>>, dist array<double>, P array<array<double>>")
    return triangulate_sessions(points.withColumn("_all", F.lit(1)), table, keys, ["_all"], cameras).drop("_all")


def world_direction(rotation: Column, v: Column, orthonormal: bool = False) -> Column:
    """A camera-frame direction in world axes, at unit length: by the inverse of R, NULL where it is singular.

    With ``orthonormal`` the transpose stands for the inverse.
    """
    return unit(matvec(transpose3(rotation) if orthonormal else inverse3(rotation), v))


def head_axes(yaw: Column, pitch: Column, roll: Column, nose_x: Column, nose_y: Column) -> Column:
    """Image end points of the head's three axes from the nose, in turn: x1, y1, x2, y2, x3, y3 after the nose's x, y."""
    m = euler_matrix(yaw - 90.0, pitch, roll + 90.0)
    ends = [matvec(m, F.array(*(F.lit(float(x)) for x in axis))) for axis in ((100, 0, 0), (0, -50, 0), (0, 0, -50))]
    return F.array(nose_x, nose_y, *(c for e in ends for c in (nose_x + F.element_at(e, 1), nose_y + F.element_at(e, 2))))
