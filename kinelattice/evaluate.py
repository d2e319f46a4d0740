"""Evaluate detector results: ``python -m kinelattice.evaluate <config.toml>``.

The configuration names the roots and what to measure::

    [io]
    predictions = "/shared/results"      # archives <dataset>__<session>[__<sequence>]/<component>/<algorithm>.npz
    output = "/shared/results_eval"
    [metrics.keypoint_metrics]           # one section per metric type
    metric_names = ["bone_length", "jump_detection"]
    components = ["body_joints"]
    gt_required = false
    [algorithms]
    body_joints = ["vitpose"]
    [keypoints.bones]
    left_upper_leg = ["left_hip", "left_knee"]
    [keypoints.diameters]
    left_hip = 0.15
    [datasets.demo]                      # one section per dataset
    truth = "/shared/demo_truth.npz"     # only where a metric needs it
    videos = [{session = "s1", sequence = "q1", start = 0, length = -1}]
    synonyms = {axis3 = {hip_l = "left_hip"}}
    [summaries.legs]                     # reports over all frame values
    metric_names = ["bone_length"]
    aggregate_dims = ["frame"]
    aggr_functions = ["mean", "std"]

A dataset that fails is reported and leaves the others.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from kinelattice.operators.evaluation import EvaluationRun, MetricType, Task, Video, evaluate_roots
from kinelattice.operators.results import Results, Summary, create_summaries
from kinelattice.sources.config import Scope, error_scope, load_toml, resolve


def tasks(config: Mapping) -> dict[str, Task]:
    """The task of every dataset; KeyError or ValueError where the configuration is incomplete."""
    algorithms = {c: tuple(a) for c, a in config["algorithms"].items()}
    types = []
    for name, own in config["metrics"].items():
        if missing := set(own["components"]) - algorithms.keys():
            raise ValueError(f"{name}: no algorithms for {sorted(missing)}")
        types.append(MetricType(name, tuple(own["metric_names"]), tuple(own["components"]), bool(own.get("gt_required", False))))
    points = config.get("keypoints", {})
    bones = {b: tuple(ends) for b, ends in points.get("bones", {}).items()}
    out = {}
    for name, own in config["datasets"].items():
        videos = tuple(Video(v["session"], v.get("sequence") or None, v.get("start", 0), v.get("length", -1)) for v in own["videos"])
        out[name] = Task(name, videos, tuple(types), algorithms, own.get("synonyms", {}), bones, points.get("diameters", {}))
    return out


def summaries(config: Mapping) -> list[Summary]:
    listed = lambda v: tuple(v) if isinstance(v, list) else (v,)
    return [
        Summary(name, tuple(s["metric_names"]), tuple(s["aggregate_dims"]), tuple(s.get("aggr_functions", ("mean", "std", "min", "max"))), tuple((k, listed(v)) for k, v in s.get("filter", {}).items()))
        for name, s in config.get("summaries", {}).items()
    ]


def run(spark: SparkSession, config: Mapping) -> tuple[dict[str, EvaluationRun], dict[str, str | None], list[str]]:
    """(runs by dataset, summary reports by name, failures): evaluate and save every dataset, then the reports over all."""
    root, output = config["io"]["predictions"], config["io"]["output"]
    runs: dict[str, EvaluationRun] = {}
    failures: list[str] = []
    for name, task in tasks(config).items():
        with error_scope(Scope.VIDEO, failures, name):
            found = evaluate_roots(spark, root, config["datasets"][name].get("truth"), task)
            found.save(output)
            runs[name] = found
        if name in runs:
            failures += [f"{name} {metric}: {why}" for metric, why in runs[name].failed.items()] + [f"{name}: unknown metric {metric}" for metric in runs[name].unknown]
    reports: dict[str, str | None] = {}
    if runs and (wanted := summaries(config)):
        every = reduce(DataFrame.unionByName, (r.frames for r in runs.values()))
        reports = create_summaries(Results.of(every), wanted, f"{output}/summaries", single=True)
    return runs, reports, failures


def main(argv: list[str] | None = None) -> int:
    paths = sys.argv[1:] if argv is None else argv
    if len(paths) != 1:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("evaluate").getOrCreate()
    runs, reports, failures = run(spark, resolve(load_toml(paths[0]), {}))
    for name, found in runs.items():
        for r in found.problems.select("path", "array_name", "problem").unionByName(found.unread).collect():  # a row per array
            failures.append(f"{name}: {r['path']} {r['array_name']}: {r['problem']}")
    print(f"evaluated {sorted(runs)}; reports {sorted(k for k, v in reports.items() if v)}")
    for line in failures:
        print(line, file=sys.stderr)
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
