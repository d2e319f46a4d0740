"""Features as table functions: each plans a DataFrame from named inputs and a configuration."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelattice.functions.vec import angle, midpoint
from kinelattice.operators import dyads, fusion, temporal
from kinelattice.session import importable
from kinelattice.sources.config import upstream

Inputs = Mapping[tuple[str, str], DataFrame]


@dataclass(frozen=True)
class Feature:
    """``plan(inputs, config)``; ``needs`` names the (component, algorithm) inputs."""

    name: str
    needs: tuple[tuple[str, str], ...]
    plan: Callable[[Inputs, Mapping], DataFrame]

    def run(self, inputs: Inputs, config: Mapping) -> DataFrame:
        if missing := [k for k in self.needs if k not in inputs]:
            raise FileNotFoundError(f"{self.name} lacks {missing}")
        return self.plan({k: inputs[k] for k in self.needs}, config)


def run_all(features: list[Feature], inputs: dict[tuple[str, str], DataFrame], configs: Mapping[str, Mapping]) -> dict[tuple[str, str], DataFrame]:
    """Plan features in dependency order; results are inputs of later ones under (feature name, "")."""
    by = {f.name: f for f in features}
    order: list[str] = []
    for f in features:
        for name in [*upstream(f.name, {g.name: [c for c, _ in g.needs if c in by] for g in features}), f.name]:
            order += [name] if name not in order else []
    have = dict(inputs)
    for name in order:
        have[(name, "")] = by[name].run(have, configs.get(name, {}))
    return {(n, ""): have[(n, "")] for n in order}


def kinematics(points: DataFrame, keys: list[str], coords: list[str], fps: float, bodyparts: DataFrame | None = None, label: str = "label") -> DataFrame:
    """Velocity of every joint, or its mean per body part (velocity only)."""
    out = temporal.velocity(points, [*keys, label], coords, fps)
    return out if bodyparts is None else fusion.bodypart_means(out, [*keys, "frame"], "velocity", bodyparts, label)


def proximity(points: DataFrame, keys: list[str], coords: list[str]) -> DataFrame:
    return dyads.body_distance(points, keys, coords)


def leaning(points: DataFrame, keys: list[str], pairs: list[tuple[str, str]], label: str = "label", v: str = "v") -> DataFrame:
    """keys (with frame), angle and its gradient: the angle over the midpoints of three keypoint pairs (coordinates only)."""
    names = [n for p in pairs for n in p]
    at = lambda n: F.max(F.when(F.col(label) == n, F.col(v)))
    wide = points.filter(F.col(label).isin(*names)).groupBy(*keys).agg(*(at(n).alias(f"_{k}") for k, n in enumerate(names)))
    a, b, c = (midpoint(F.col(f"_{2 * k}"), F.col(f"_{2 * k + 1}")) for k in range(3))
    out = wide.select(*keys, angle(a, b, c).alias("angle"))
    return temporal.gradient(out, [k for k in keys if k != "frame"], "angle")


def gaze_interaction(heads: DataFrame, gaze: DataFrame, keys: list[str], person: str = "person", threshold: float = 0.4) -> DataFrame:
    """Distance of every gaze line from every face, looking at and mutual looking."""
    return dyads.gaze_contact(heads, gaze, keys, person, threshold)


def gaze_multiview(inputs: list[DataFrame], keys: list[str], coords: list[str], weight: str | None = None, calibration: DataFrame | None = None, session: list[str] | None = None) -> DataFrame:
    """Gaze fused over the cameras of all algorithms and, with calibration, its vector in the images of its session's cameras."""
    fused = fusion.ensemble(inputs, keys, coords, weight)
    return fused if calibration is None else fusion.project_gaze(fused, calibration, keys, session=session)


#: The feature functions by name.
FEATURES: dict[str, Callable[..., DataFrame]] = {
    "kinematics": kinematics,
    "proximity": proximity,
    "leaning": leaning,
    "gaze_interaction": gaze_interaction,
    "gaze_multiview": gaze_multiview,
}


def model_hook(rows: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's model over Arrow batches: the place of the external detectors."""
    importable(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield predict(b)

    return rows.mapInPandas(run, schema)
