"""The evaluation run over archives against a plain computation."""

import collections
import csv
import json
import math

import numpy as np
import pytest

from kinelattice import evaluate as command
from kinelattice.operators import evaluation
from kinelattice.operators.evaluation import MetricType, Task, Video
from kinelattice.sources import npz

PEOPLE, FRAMES = ["ann", "bo"], list(range(3, 15))
JOINTS = ["hip", "knee", "foot", "nose"]
BONES = {"leg": ("hip", "knee"), "shin": ("knee", "foot"), "tail": ("hip", "tip")}
DIAMETERS = {"hip": 0.001, "knee": 0.002}


def save(path, **arrays):
    path.parent.mkdir(parents=True, exist_ok=True)
    known = {k: a for k, (a, _) in arrays.items()}
    np.savez(path, **{k: v for k, (_, v) in arrays.items()}, data_description=np.array(json.dumps(known)))


def axes(*names):
    return {f"axis{k}": n for k, n in enumerate(names)}


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    """Two sessions of one dataset and another dataset, with truth in other orders, a synonym and a missing frame."""
    root = tmp_path_factory.mktemp("pred")
    rng = np.random.default_rng(8)
    frames = [f"{f:09d}" for f in FRAMES]
    pred, truth, flags, true = {}, {}, {}, {}
    held = {}
    for s in ("s1", "s2"):
        order = JOINTS if s == "s1" else JOINTS[::-1]
        p = rng.normal(0, 1.5, (2, 1, len(FRAMES), 4, 4)).astype(np.float32)
        p[0, 0, 2, 1, 0] = np.nan
        flat = rng.normal(size=(2, 2, len(FRAMES), 4, 3)).astype(np.float32)
        look = rng.integers(0, 2, (2, 1, len(FRAMES), 2)).astype(np.float32)
        save(root / f"demo__{s}__q" / "body_joints" / "net.npz", **{"3d": (axes(PEOPLE, ["3d"], frames, order, ["x", "y", "z", "confidence_score"]), p), "2d_interpolated": (axes(PEOPLE, ["c1", "c2"], frames, order, ["x", "y", "confidence_score"]), flat), "raw": (axes(PEOPLE, ["3d"], frames, order), p[..., 0])})
        save(root / f"demo__{s}__q" / "gaze_interaction" / "look.npz", gaze_look_at_3d=(axes(PEOPLE, ["3d"], frames, PEOPLE), look))
        for i, a in enumerate(PEOPLE):
            for f, n in enumerate(FRAMES):
                for j, label in enumerate(order):
                    pred[s, a, n, label] = p[i, 0, f, j, :3].astype(float)
                for j, other in enumerate(PEOPLE):
                    flags[s, a, n, other] = look[i, 0, f, j]
        # truth: other order of joints and coordinates, a synonym, no nose, the first frames missing; people swapped
        t = rng.normal(size=(2, 1, len(FRAMES) - 2, 3, 3)).astype(np.float32)
        g = rng.integers(0, 2, (2, 1, len(FRAMES) - 2, 2)).astype(np.float32)
        held[f"{s}__q__3d"] = (axes(PEOPLE[::-1], ["3d"], frames[2:], ["foot", "old_hip", "knee"], ["z", "x", "y"]), t)
        for i, a in enumerate(PEOPLE[::-1]):
            for f, n in enumerate(FRAMES[2:]):
                for j, label in enumerate(["foot", "hip", "knee"]):
                    z, x, y = t[i, 0, f, j].astype(float)
                    truth[s, a, n, label] = np.array([x, y, z])
        true[s] = g
    save(root / "demo__s9__q" / "body_joints" / "net.npz", **{"3d": (axes(PEOPLE, ["3d"], frames, JOINTS, ["x", "y", "z", "confidence_score"]), np.ones((2, 1, len(FRAMES), 4, 4)))})
    save(root / "other__s1__q" / "body_joints" / "net.npz", **{"3d": (axes(["p"], ["3d"], ["1", "2"], ["a"], ["x", "y", "z"]), np.ones((1, 1, 2, 1, 3)))})
    (root / "demo__s1__q" / "body_joints" / "broken.npz").write_bytes(b"no archive")
    save(root.parent / "truth.npz", **held)
    return str(root), str(root.parent / "truth.npz"), pred, truth, flags


TYPES = (MetricType("point_cloud_metrics", ("jpe", "absent"), ("body_joints",), True), MetricType("keypoint_metrics", ("bone_length", "jump_detection"), ("body_joints",)))


def task(dataset="demo", videos=(Video("s1", "q", 5, 100), Video("s2", "q")), types=TYPES, **more):
    return Task(dataset, videos, types, {"body_joints": ("net",), "gaze_interaction": ("look",)}, {"axis3": {"old_hip": "hip"}}, BONES, DIAMETERS, **more)


def inside(s, n):
    return s == "s2" or n >= 5


def norm(x):
    return None if np.isnan(x).any() else float(np.sqrt((x * x).sum()))


def brute(pred, truth):
    out = {}
    for (s, a, n, label), v in pred.items():
        if not inside(s, n):
            continue
        if label != "nose":
            t = truth.get((s, a, n, label))
            out["jpe", s, a, "3d", n, label] = None if t is None else norm(v - t)
        before = pred.get((s, a, n - 1, label))
        if before is not None and inside(s, n - 1):
            moved = norm(v - before)
            out["jump_detection", s, a, "3d", n, label] = float(moved is not None and moved > DIAMETERS.get(label, math.inf) * 1000)
    for s, a, n in {k[:3] for k in pred}:
        if inside(s, n):
            for b, (x, y) in BONES.items():
                out["bone_length", s, a, "3d", n, b] = norm(pred[s, a, n, x] - pred[s, a, n, y]) if y in JOINTS else None
    return out


def close(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, rel=1e-6)), k


def test_two_roots(spark, roots, tmp_path):
    root, truth_path, pred, truth, _ = roots
    run = evaluation.evaluate_roots(spark, root, truth_path, task())
    assert run.unknown == ["point_cloud_metrics/absent"] and run.failed == {}
    rows = run.frames.collect()
    got = {(r["metric_name"], r["session"], r["person"], r["camera"], r["frame"], r["label"]): r["value"] for r in rows if r["camera"] == "3d"}
    assert len(got) == len([r for r in rows if r["camera"] == "3d"])
    want = brute(pred, truth)
    close(got, want)
    problems = {(r["session"], r["array_name"], r["metric_type"], r["problem"]) for r in run.problems.collect()}
    assert problems == {(s, "2d_interpolated", "point_cloud_metrics", "no ground truth") for s in ("s1", "s2")}
    summary = {(r["metric"], r["person"]): r["value"] for r in run.summary.collect()}
    for a in PEOPLE:
        for b in ("leg", "shin"):
            own = [v for k, v in want.items() if k[0] == "bone_length" and k[2] == a and k[5] == b and v is not None]
            assert summary[f"mean_bone_length__{b}", a] == pytest.approx(np.mean(own)) and summary[f"std_bone_length__{b}", a] == pytest.approx(np.std(own, ddof=1))
        assert summary["jump_count", a] == sum(v for k, v in want.items() if k[0] == "jump_detection" and k[2] == a) > 0
    files = run.save(str(tmp_path))
    assert sum(f.endswith(".npz") for f in files) == 4
    assert [(r["path"].split("/")[-1], r["problem"]) for r in run.unread.collect()] == [("broken.npz", "no readable description")]
    back = npz.long_values(npz.read_npz(spark, str(tmp_path))).filter("metric_name = 'jpe' and value is not null").collect()
    close({("jpe", r["session"], r["person"], r["camera"], r["frame"], r["label"]): r["value"] for r in back}, {k: np.float32(v) for k, v in want.items() if k[0] == "jpe" and v is not None})
    with open(tmp_path / "demo_keypoint_metrics_summary.csv") as f:
        assert {r["metric"] for r in csv.DictReader(f)} == {k for k, _ in summary}


def test_flags_against_truth(spark, roots, tmp_path):
    root, _, _, _, flags = roots
    frames = [f"{f:09d}" for f in FRAMES]
    g = np.random.default_rng(3).integers(0, 2, (2, 1, len(FRAMES), 2)).astype(np.float32)
    save(tmp_path / "t.npz", **{"s1__q__3d": (axes(PEOPLE, ["3d"], frames, PEOPLE[::-1]), g)})
    names = ("accuracy", "precision", "recall", "f1_score")
    run = evaluation.evaluate_roots(spark, root, str(tmp_path / "t.npz"), task(types=(MetricType("categorical_metrics", names, ("gaze_interaction",), True),)))
    got = {(r["metric"], r["person"]): r["value"] for r in run.summary.collect()}
    for i, a in enumerate(PEOPLE):
        n = collections.Counter()
        for f, frame in enumerate(FRAMES):
            for j, other in enumerate(PEOPLE[::-1]):
                if inside("s1", frame):
                    n[bool(flags["s1", a, frame, other]), bool(g[i, 0, f, j])] += 1
        p, r = n[1, 1] / (n[1, 1] + n[1, 0]), n[1, 1] / (n[1, 1] + n[0, 1])
        want = {"accuracy": (n[1, 1] + n[0, 0]) / sum(n.values()), "precision": p, "recall": r, "f1_score": 2 * p * r / (p + r)}
        assert {k: got[k, a] for k in names} == pytest.approx(want)
    assert [r["session"] for r in run.problems.collect()] == ["s2"] and run.frames.count() == 0


def test_a_failing_metric_leaves_the_others(spark, roots):
    root, truth_path, *_ = roots
    types = (*TYPES[1:], MetricType("point_cloud_metrics", ("jpe",), ("body_joints",), True))
    run = evaluation.evaluate_roots(spark, root, truth_path, task("other", (Video("s1", "q"),), types))
    assert run.failed.keys() == {"keypoint_metrics/bone_length", "keypoint_metrics/jump_detection"} and "confidence" in run.failed["keypoint_metrics/bone_length"]
    assert [r["problem"] for r in run.problems.collect()] == ["no common labels"] and run.frames.count() == 0
    alone = evaluation.evaluate_roots(spark, root, None, task(types=TYPES[:1]))
    assert alone.frames.count() == 0 and {r["problem"] for r in alone.items.collect()} == {"no ground truth"}
    assert evaluation.evaluate_roots(spark, root, None, task("absent")).items.count() == 0


def test_positions(spark):
    schema = "path string, dataset string, session string, sequence string, component string, algorithm string, array_name string, shape array<bigint>, axis3 array<string>, axis4 array<string>, problem string"
    row = lambda name, a3, a4, session="S", seq="Q": (name, "demo", session, seq, "body_joints", "net", name, [1] * (5 if a4 else 4), a3, a4, None)

    def places(pred, truth):
        axes = spark.createDataFrame([row("3d", *pred)], schema)
        other = spark.createDataFrame([row("S__Q__3d", *truth)], schema)
        r = evaluation.work_items(axes, other, task(videos=(Video("S", "Q"),), types=TYPES[:1])).first()
        return r["problem"] or (r["labels"], r["pred_at"], r["truth_at"])

    assert places((["a", "b", "c", "d"], ["x", "y", "z", "conf"]), (["c", "b", "a"], ["x", "y", "conf"])) == (["a", "b", "c"], [1, 2], [1, 2])
    assert places((["a", "b"], ["y", "x"]), (["b", "a"], ["x", "y"])) == (["a", "b"], [1, 2], [2, 1])
    assert places((["a"], ["x"]), (["old_hip"], ["x"])) == "no common labels" and places((["hip"], ["x"]), (["old_hip"], ["x"])) == (["hip"], [1], [1])
    assert places((["a"], ["x"]), (["a"], ["y"])) == "no common labels" and places((["a"], ["x"]), (["a"], None)) == "no common labels"
    assert places((["p", "q"], None), (["q", "r", "p"], None)) == (None, [1, 2], [3, 1])


def test_command(spark, roots, tmp_path, capsys):
    root, truth_path, *_ = roots
    config = tmp_path / "run.toml"
    config.write_text(f"""
[io]
predictions = "{root}"
output = "{tmp_path}/out"
[metrics.point_cloud_metrics]
metric_names = ["jpe"]
components = ["body_joints"]
gt_required = true
[metrics.keypoint_metrics]
metric_names = ["bone_length"]
components = ["body_joints"]
[algorithms]
body_joints = ["net"]
[keypoints.bones]
leg = ["hip", "knee"]
[datasets.demo]
truth = "{truth_path}"
videos = [{{session = "s1", sequence = "q"}}]
synonyms = {{axis3 = {{old_hip = "hip"}}}}
[datasets.gone]
truth = "{tmp_path}/absent.npz"
videos = [{{session = "s1", sequence = "q"}}]
[summaries.bones]
metric_names = ["bone_length"]
aggregate_dims = ["frame", "person"]
aggr_functions = ["mean"]
filter = {{label = "leg"}}
[summaries.skipped]
metric_names = ["jump_detection"]
aggregate_dims = ["frame"]
""")
    assert command.main([str(config)]) == 1
    out, err = capsys.readouterr()
    assert "evaluated ['demo']; reports ['bones']" in out and "gone" in err and "no ground truth" in err
    with open(tmp_path / "out" / "summaries" / "bones.csv") as f:
        assert [r["label"] for r in csv.DictReader(f)] == ["leg"]
    assert command.main([]) == 2
