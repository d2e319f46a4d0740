"""Typed configurations: schemas by name, inheritance, and all errors at once."""

from dataclasses import dataclass, field
from pathlib import Path

import pytest

from kinelattice.operators.results import AGGREGABLE
from kinelattice.sources.schema import ConfigErrors, Registry, parse_detectors, validate


@dataclass(frozen=True)
class Paths:
    experiment_name: str
    experiment_folder: Path
    output_folder: Path
    eval_visualization_folder: Path


@dataclass(frozen=True)
class MetricSection:
    metric_names: list[str]
    gt_required: bool
    gt_components: list[str] | None = None


@dataclass(frozen=True)
class SummarySection:
    metric_names: list[str]
    aggr_functions: list[str] = field(metadata={"subset_of": ("mean", "std", "min", "max")})
    filter: dict[str, str | list[str]] = field(default_factory=dict)
    aggregate_dims: tuple[str, ...] = field(default=(), metadata={"subset_of": AGGREGABLE})


@dataclass(frozen=True)
class Evaluation:
    io: Paths
    batchsize: int = field(default=1000, metadata={"between": (1, 100_000)})
    device: str = field(default="cpu", metadata={"one_of": ("cpu", "cuda:0")})
    fraction: float = 1.0
    size: tuple[int, int] = (1, 1)
    metrics: dict[str, MetricSection] = field(default_factory=dict)
    summaries: dict[str, SummarySection] = field(default_factory=dict)


GOOD = {"experiment_name": "e", "experiment_folder": "/path/to/exp", "output_folder": "/path/to/out", "eval_visualization_folder": "/path/to/viz"}


def test_a_whole_configuration():
    got = validate(Evaluation, {"io": GOOD, "fraction": 2, "size": [3, 4], "metrics": {"m": {"metric_names": ["jpe"], "gt_required": True}}, "summaries": {"s": {"metric_names": ["jpe"], "aggr_functions": ["mean"], "filter": {"label": ["a"], "dataset": "d"}, "aggregate_dims": ["frame"]}}})
    assert got.io.experiment_folder == Path("/path/to/exp") and isinstance(got.io.output_folder, Path) and got.fraction == 2.0 and got.size == (3, 4)
    assert got.metrics["m"].gt_components is None and got.summaries["s"].aggregate_dims == ("frame",) and got.batchsize == 1000


def test_all_errors_at_once():
    raw = {"io": {"experiment_folder": 3, "eval_visualization_folder": "/v", "new": 1}, "batchsize": 0, "device": "tpu", "fraction": "half", "size": [1], "metrics": {"m": {"metric_names": "jpe", "gt_required": 1}, "n": 5}, "summaries": {"s": {"metric_names": ["a", 2], "aggr_functions": ["mode"], "aggregate_dims": ["dataset"], "filter": {"x": 1}}}}
    with pytest.raises(ConfigErrors) as e:
        validate(Evaluation, raw)
    places = sorted(line.split(":")[0] for line in e.value.errors)
    assert places == sorted([
        "io.new", "io.experiment_name", "io.experiment_folder", "io.output_folder", "batchsize", "device", "fraction", "size", "metrics.m.metric_names", "metrics.m.gt_required", "metrics.n", "summaries.s.metric_names[1]", "summaries.s.aggr_functions", "summaries.s.aggregate_dims", "summaries.s.filter.x",
    ])
    with pytest.raises(ConfigErrors, match="output_folder: missing"):
        validate(Paths, {k: v for k, v in GOOD.items() if k != "output_folder"})


@dataclass(frozen=True)
class Framework:
    env_name: str
    device: str = "cpu"


@dataclass(frozen=True)
class Pose:
    framework: str
    camera_names: list[str]
    window_length: int
    env_name: str = "own"
    device: str = "cpu"


@dataclass(frozen=True)
class Anything:
    extra = True
    camera_names: list[str] = field(default_factory=list)


def registries():
    algorithms, frameworks = Registry("kind", Anything), Registry()
    algorithms.register("pose")(Pose)
    frameworks.register("mm")(Framework)
    return algorithms, frameworks


def test_framework_keys_lie_on_top():
    pose = {"kind": "pose", "framework": "mm", "camera_names": ["c1"], "window_length": 11, "env_name": "mine"}
    config = {"frameworks": {"mm": {"env_name": "mm_env", "device": "cuda:0"}}, "algorithms": {"vit": pose, "other": {"camera_names": ["c2"], "odd": 1}}}
    algorithms, frameworks = registries()
    made, held = parse_detectors(config, algorithms, frameworks)
    assert made["vit"].env_name == "mm_env" and made["vit"].device == "cuda:0" and held["mm"].device == "cuda:0" and made["other"].camera_names == ["c2"]
    assert config["algorithms"]["vit"]["env_name"] == "mine"  # the input stays


def test_schema_by_key_and_errors_of_all_sections():
    algorithms, frameworks = registries()
    assert algorithms.schema_of("x", {"kind": "pose"}) is Pose and algorithms.schema_of("x", {}) is Anything and frameworks.schema_of("x", {}) is None
    config = {"frameworks": {"mm": {"device": "cpu"}, "new": {}}, "algorithms": {"pose": {"framework": "absent", "camera_names": ["c"]}, "other": {"camera_names": 4}}}
    with pytest.raises(ConfigErrors) as e:
        parse_detectors(config, algorithms, frameworks)
    assert sorted(x.split(":")[0] for x in e.value.errors) == ["algorithms.other.camera_names", "algorithms.pose.framework", "algorithms.pose.window_length", "frameworks.mm.env_name", "frameworks.new"]
