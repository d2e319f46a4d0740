"""Calibration tables: one row per camera, complete matrices, from JSON files keyed by session and sequence."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from kinelattice.operators.cameras import complete

SCHEMA = "dataset string, session string, sequence string, camera string, image_size array<int>, K array<array<double>>, R array<array<double>>, Rt array<array<double>>, P array<array<double>>, dist array<double>, rvec array<double>, t array<double>"


def key(session: str, sequence: str | None) -> str:
    return "__".join(x for x in (session, sequence) if x and x != "None")


def load(spark: SparkSession, path: str | Path, dataset: str, session: str, sequence: str | None, cameras: list[str]) -> DataFrame:
    """The requested cameras of one session; KeyError where session or camera is absent."""
    with open(path) as f:
        held = json.load(f)
    name = key(session, sequence)
    if name not in held:
        raise KeyError(f"no calibration for {name}; there are {sorted(held)}")
    if missing := set(cameras) - held[name].keys():
        raise KeyError(f"no calibration for cameras {sorted(missing)}")
    rows = []
    for camera in cameras:
        own = complete(held[name][camera])
        size = held[name][camera].get("image_size")
        rows.append((dataset, session, sequence, camera, size, *(own[c].tolist() for c in ("K", "R", "Rt", "P", "d", "r", "t"))))
    return spark.createDataFrame(rows, SCHEMA)


def save(path: str | Path, sessions: dict[tuple[str, str | None], dict[str, dict]]) -> Path:
    """Write completed cameras by session and sequence as JSON."""
    out = {key(*k): {c: {n: v.tolist() for n, v in complete(x).items()} | ({"image_size": x["image_size"]} if "image_size" in x else {}) for c, x in cams.items()} for k, cams in sessions.items()}
    Path(path).write_text(json.dumps(out))
    return Path(path)
