"""Hand-computed cases, edge rules and invariants of the frame-series operators."""

import functools
import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinelattice.functions import vec
from kinelattice.operators import align, cameras, detections, dyads, features, fusion, metrics, tables, temporal
from kinelattice.operators.results import Results, Summary, create_summaries, summarise, write_metric_summaries, write_small_csv
from kinelattice.sources import calibration


def kept_boxes(boxes, scores, threshold):
    """Places left when pairs are tried in order and the lower-scored box of an overlapping pair goes."""
    gone = set()
    for i, j in itertools.combinations(range(len(boxes)), 2):
        if gone & {i, j}:
            continue
        a, b = boxes[i], boxes[j]
        both = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
        whole = sum((c[2] - c[0]) * (c[3] - c[1]) for c in (a, b)) - both
        if whole > 0 and both / whole > threshold:
            gone.add(j if scores[j] < scores[i] else i)
    return [k for k in range(len(boxes)) if k not in gone]


def exchanges(df):
    plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange "), plan


def one(spark, **exprs):
    return spark.range(1).select(*(e.alias(n) for n, e in exprs.items())).first()


def arr(*xs):
    return F.array(*(F.lit(None if x is None else float(x)).cast("double") for x in xs))


def test_joint_error(spark):
    rows = [("a", [0.0, 0, 0], [3.0, 0.0, 4.0]), ("b", [5.0, 5, 5], [5.0, 5.0, 5.0]), ("c", [1.0, 0, 0], [2.0, 0.0, 0.0]), ("d", [0.0, 0], [3.0, 4.0]), ("e", [1.0], None)]
    df = spark.createDataFrame([(k, [float(x) for x in p], g and [float(x) for x in g]) for k, p, g in rows], "label string, v_pred array<double>, v_gt array<double>")
    assert {r["label"]: r["jpe"] for r in metrics.joint_error(df).collect()} == {"a": 5.0, "b": 0.0, "c": 1.0, "d": 5.0, "e": None}


def test_bone_length_and_summary(spark):
    pts = [(f, "p1", l, v) for f, (a, b) in enumerate([([0.0, 0.0, 0.0], [3.0, 4.0, 0.0]), ([1.0, 1.0, 1.0], [1.0, 1.0, 1.0])]) for l, v in (("s", a), ("e", b))]
    df = spark.createDataFrame(pts, "frame int, person string, label string, v array<double>")
    bones = spark.createDataFrame([("l_arm", "s", "e"), ("r_arm", "x", "y")], "bone string, start string, end string")
    lengths = metrics.bone_lengths(df, ["frame", "person"], bones)
    assert {r["frame"]: r["bone_length"] for r in lengths.collect()} == {0: 5.0, 1: 0.0}
    got = {r["metric"]: r["value"] for r in metrics.bone_summary(lengths, ["person"]).collect()}
    assert got["mean_bone_length__l_arm"] == 2.5 and abs(got["std_bone_length__l_arm"] - 3.5355339) < 1e-6


def test_jumps_follow_series_and_missing_values(spark):
    rows = [("A", "k", 0, 0.0), ("A", "k", 1, 200.0), ("A", "k", 2, None), ("A", "k", 3, 900.0), ("B", "k", 0, 9999.0), ("B", "k", 1, 9999.0), ("A", "free", 0, 0.0), ("A", "free", 1, 1e9)]
    df = spark.createDataFrame(rows, "session string, label string, frame int, x double")
    limits = spark.createDataFrame([("k", 0.15)], "label string, d double")
    got = {(r["session"], r["label"], r["frame"]): r["jump"] for r in temporal.jump_flags(df, ["session", "label"], ["x"], limits, "label", "d").collect()}
    assert got == {("A", "k", 0): None, ("A", "k", 1): True, ("A", "k", 2): False, ("A", "k", 3): False, ("B", "k", 0): None, ("B", "k", 1): False, ("A", "free", 0): None, ("A", "free", 1): False}


def test_previous_frame_only(spark):
    df = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 4.0), ("s", 5, 9.0)], "k string, frame int, x double")
    by = lambda g: {r["frame"]: r["d_x"] for r in temporal.displacement(df, ["k"], ["x"], gaps=g).collect()}
    assert by("row") == {1: None, 2: 3.0, 5: 5.0} and by("frame") == {1: None, 2: 3.0, 5: None}


@pytest.mark.parametrize("values,want", [([1.0, 3, 5, 7], [2.0] * 4), ([0.0, 1, 4, 9], [1.0, 2.0, 4.0, 5.0]), ([1.0, 4], [3.0, 3.0]), ([1.0], [None])])
def test_gradient(spark, values, want):
    df = spark.createDataFrame([("s", k, float(x)) for k, x in enumerate(values)], "k string, frame int, x double")
    assert [r["gradient"] for r in temporal.gradient(df, ["k"], "x").orderBy("frame").collect()] == want


def test_savgol_keeps_polynomials_and_spreads_nulls(spark):
    poly = [3 - 2 * t + 0.5 * t * t for t in range(50)]
    rows = [("p", t, x) for t, x in enumerate(poly)] + [("n", t, None if t == 20 else float(t)) for t in range(50)]
    out = temporal.savgol(spark.createDataFrame(rows, "k string, frame int, x double"), ["k"], "x").collect()
    assert all(abs(r["smoothed"] - poly[r["frame"]]) < 1e-8 for r in out if r["k"] == "p")
    assert {r["frame"] for r in out if r["k"] == "n" and r["smoothed"] is None} == set(range(15, 26))
    short = temporal.savgol(spark.createDataFrame([("s", 0, 1.0)], "k string, frame int, x double"), ["k"], "x")
    with pytest.raises(Exception, match="shorter than the window"):
        short.collect()
    with pytest.raises(ValueError):
        temporal.savgol(short, ["k"], "x", window=10)


def test_savgol_equals_least_squares(spark):
    x = np.random.default_rng(3).normal(size=30)
    out = temporal.savgol(spark.createDataFrame([("s", t, float(v)) for t, v in enumerate(x)], "k string, frame int, x double"), ["k"], "x", 7, 3)
    for r in out.collect():
        low = min(max(r["frame"] - 3, 0), 23)
        fit = np.polyfit(np.arange(low, low + 7), x[low : low + 7], 3)
        assert abs(np.polyval(fit, r["frame"]) - r["smoothed"]) < 1e-8


def test_interpolation_strict_and_compat(spark):
    seen = {**{t: float(t) for t in range(4)}, 4: 100.0, **{t: float(t) for t in range(30, 35)}}
    df = spark.createDataFrame([("s", t, seen.get(t)) for t in range(36)], "k string, frame int, x double")
    strict = {r["frame"]: r["x"] for r in temporal.interpolate(df, ["k"], ["x"]).collect()}
    assert strict[4] == 100.0 and strict[10] is None and strict[35] is None
    compat = {r["frame"]: r["x"] for r in temporal.interpolate(df, ["k"], ["x"], compat=True).collect()}
    assert compat[10] is not None and abs(compat[4] - 4.0) < 1.0
    small = spark.createDataFrame([("s", t, x) for t, x in enumerate([None, 1.0, None, None, 4.0, None])], "k string, frame int, x double")
    assert [r["x"] for r in temporal.interpolate(small, ["k"], ["x"]).orderBy("frame").collect()] == [None, 1.0, 2.0, 3.0, 4.0, None]


def test_angle_line_and_direction(spark):
    r = one(spark, s=vec.angle(arr(0, 0), arr(1, 0), arr(2, 0)), right=vec.angle(arr(0, 0), arr(1, 0), arr(1, 1)), same=vec.angle(arr(1, 1), arr(1, 1), arr(2, 2)),
            through=vec.point_line_distance(arr(5, 0, 0), arr(0, 0, 0), arr(1, 0, 0)), behind=vec.point_line_distance(arr(-5, 0, 0), arr(0, 0, 0), arr(1, 0, 0)),
            zero=vec.point_line_distance(arr(1, 2, 3), arr(0, 0, 0), arr(0, 0, 0)), off=vec.point_line_distance(arr(5, 3, 4), arr(0, 0, 0), arr(2, 0, 0)), unit=vec.unit(arr(0, 0)))
    assert abs(r["s"]) < 1e-9 and abs(r["right"] - 90) < 1e-9 and r["same"] is None
    assert r["through"] == 0 and r["behind"] == 0 and r["zero"] is None and abs(r["off"] - 5) < 1e-12 and list(r["unit"]) == [None, None]


def test_nan_becomes_null(spark):
    r = one(spark, a=vec.nan_to_null(F.lit(float("nan"))), b=vec.nan_to_null(F.lit(1.0)), c=vec.array_nan_to_null(F.array(F.lit(float("nan")), F.lit(2.0))), d=vec.strict_least(F.lit(1.0), F.lit(None).cast("double")))
    assert r["a"] is None and r["b"] == 1.0 and r["c"] == [None, 2.0] and r["d"] is None


def test_box_overlap_values(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 15.0, 10.0, 5.0, 0.0), (3, 8.0, 0.0, 18.0, 10.0), (4, 50.0, 50.0, 60.0, 60.0), (5, None, 0.0, 1.0, 1.0), (6, 1.0, 1.0, 1.0, 1.0)], "person int, x1 double, y1 double, x2 double, y2 double")
    got = {(r["person"], r["other"]): r["iou"] for r in dyads.box_overlaps(boxes.withColumn("f", F.lit(0)), ["f"]).collect()}
    assert abs(got[1, 2] - 1 / 3) < 1e-9 and abs(got[1, 3] - 1 / 9) < 1e-9 and abs(got[2, 3] - 7 / 13) < 1e-9
    assert got[1, 4] == 0 and got[1, 1] == 1 and got[1, 5] is None and got[6, 6] is None
    assert all(got[a, b] == got[b, a] for a, b in got)


def test_gaze_contact(spark):
    heads = spark.createDataFrame([(0, "a", [0.0, 0.0, 0.0]), (0, "b", [1.0, 0.0, 0.0]), (1, "a", [0.0, 0.0, 0.0]), (1, "b", [1.0, 0.0, 0.0])], "frame int, person string, head array<double>")
    gaze = spark.createDataFrame([(0, "a", [1.0, 0.0, 0.0]), (0, "b", [-1.0, 0.0, 0.0]), (1, "a", [0.0, 1.0, 0.0]), (1, "b", [0.0, 0.0, 0.0])], "frame int, person string, direction array<double>")
    got = {(r["frame"], r["person"], r["target"]): (r["distance"], r["look_at"], r["mutual"]) for r in dyads.gaze_contact(heads, gaze, ["frame"]).collect()}
    assert got[0, "a", "b"] == (0.0, True, True) and got[0, "a", "a"] == (0.0, False, False)
    assert got[1, "a", "b"] == (1.0, False, False) and got[1, "b", "a"] == (None, False, False)


def test_body_distance_needs_two(spark):
    df = spark.createDataFrame([(0, "a", 0.0, 0.0), (0, "b", 3.0, 4.0), (1, "a", 0.0, 0.0), (2, "a", 0.0, None), (2, "b", 1.0, 1.0)], "frame int, person string, x double, y double")
    got = {(r["frame"], r["person"]): r["distance"] for r in dyads.body_distance(df, ["frame"], ["x", "y"]).collect()}
    assert got == {(0, "a"): 5.0, (0, "b"): 5.0, (2, "a"): None, (2, "b"): None}


def test_weighted_fusion(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0, 1.0), (0, 0.0, 1.0, None), (1, 1.0, None, 5.0), (1, 0.0, 2.0, 1.0), (2, 1.0, 1.0, 0.0)], "f int, x double, y double, w double")
    got = {r["f"]: r["fused"] for r in fusion.fuse_weighted(df, ["f"], ["x", "y"], "w").collect()}
    assert got[0] == [1.0, 0.0] and got[1] == [0.0, 1.0] and got[2] == [None, None]
    both = fusion.ensemble([df.drop("w"), df.drop("w")], ["f"], ["x", "y"], "w").collect()
    assert len(both) == 3


def test_argmax_ties(spark):
    df = spark.createDataFrame([(0, "a", 1.0, 0), (0, "b", 1.0, 1), (1, "a", 0.0, 0), (1, "b", 2.0, 1)], "f int, e string, v double, pos int")
    assert {r["f"]: r["e"] for r in fusion.argmax_label(df, ["f"], "e", "v", "pos").collect()} == {0: "a", 1: "b"}


def test_categorical_scores(spark):
    rows = [("n", 0, 0), ("n", 0, 0), ("p", 1, 1), ("m", 1, 0), ("m", 0, 1), ("m", 1, 1)]
    c = metrics.confusion(spark.createDataFrame(rows, "g string, p int, t int"), ["g"], F.col("p") != 0, F.col("t") != 0)
    got = {r["g"]: tuple(round(r[n], 4) for n in metrics.CATEGORICAL) for r in c.select("g", *(m().alias(n) for n, m in metrics.CATEGORICAL.items())).collect()}
    assert got == {"n": (1.0, 0.0, 0.0, 0.0), "p": (1.0, 1.0, 1.0, 1.0), "m": (0.3333, 0.5, 0.5, 0.5)}


def test_metric_registry(spark):
    run = metrics.run_metrics(["good", "bad", "absent"], {"good": lambda: spark.range(1), "bad": lambda: 1 / 0})
    assert list(run.plans) == ["good"] and run.unknown == ["absent"] and "ZeroDivision" in run.failed["bad"]


def results(spark):
    rows = [("jpe", "s1", "a", 0, 1.0), ("jpe", "s1", "a", 1, 3.0), ("jpe", "s1", "b", 0, float("nan")), ("jump", "s2", "a", 0, 5.0)]
    return Results.of(spark.createDataFrame(rows, "metric_name string, sequence string, person string, frame int, value double"))


def test_results_view(spark, tmp_path):
    r = results(spark)
    assert r.available_metrics == ["jpe", "jump"]
    mean = r.query(metric_name="jpe").aggregate("person").collect()
    assert [(x["person"], x["value"]) for x in mean] == [("a", 2.0), ("b", None)]
    many = r.query(metric_name="jpe").aggregate(["person"], ["mean", "std", "sum", "count"]).collect()
    assert [tuple(x) for x in many] == [("a", 2.0, math.sqrt(2), 4.0, 2), ("b", None, None, 0.0, 0)]
    assert r.query(metric_name="jpe").reset().view.count() == 4 and r.query().view.count() == 4
    assert r.to_dataframe(dropna=True).count() == 3 and r.query(person=[]).view.count() == 0
    for bad in ({"nope": 1}, {"person": "zz"}, {"person": "b", "metric_name": "jump"}):
        with pytest.raises(KeyError):
            r.query(strict=True, **bad)
    with pytest.raises(ValueError):
        r.aggregate("person", "mode")
    assert r.to_csv(str(tmp_path)).endswith("summary.csv") and (tmp_path / "summary.csv").exists()
    assert write_small_csv(r.view, str(tmp_path / "one"), "s").read_text().count("\n") == 5


def test_summaries(spark, tmp_path):
    r = results(spark)
    with pytest.raises(ValueError):
        Summary("x", ("jpe",), ("component",))
    assert summarise(r, Summary("x", ("absent",), ("frame",))) is None
    got = create_summaries(r, [Summary("a", ("jpe",), ("frame",), filters=(("metric_name", ("jpe", "jump")),)), Summary("b", ("zz",), ("frame",))], str(tmp_path))
    assert got["a"].endswith("a.csv") and got["b"] is None


def test_alignment(spark):
    assert align.reconcile(["a", "b", "c", "d"], ["c", "b", "a"]) == ([0, 1, 2], [2, 1, 0]) and align.reconcile(None, None) is None
    with pytest.raises(ValueError):
        align.reconcile(["a"], ["b"])
    assert align.truth_key("S1", "Seq1", "3d") == "S1__Seq1__3d" and align.truth_key("S1", "", "3d") == "S1__3d"
    r = one(spark, a=F.array(*align.split_truth_key(F.lit("S1__Seq1__3d"))), b=F.array(*align.split_truth_key(F.lit("S1__3d"))))
    assert r["a"] == ["S1", "Seq1", "3d"] and r["b"] == ["S1", None, "3d"]
    f = spark.range(20).select(F.col("id").cast("int").alias("frame"))
    assert f.filter(align.frame_range(5, 10)).count() == 10 and f.filter(align.frame_range(5, -1)).count() == 15
    p = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "frame int, v array<double>")
    assert {x["frame"]: x["v_gt"] for x in align.align(p, p.filter("frame = 0"), ["frame"]).collect()} == {0: [1.0], 1: None}
    s = spark.createDataFrame([("body_joints", "3d"), ("body_joints", "2d"), ("other", "3d")], "component string, array_name string")
    assert align.allowed_arrays(s).count() == 1


def test_detections(spark):
    assert kept_boxes(np.array([[0, 0, 10, 10], [0, 0, 10, 10.5], [50, 50, 60, 60.0]]), np.array([0.9, 0.8, 0.7]), 0.9) == [0, 2]
    assert kept_boxes(np.array([[0, 0, 10, 10], [0, 0, 10, 10.0]]), np.array([0.5, 0.5]), 0.9) == [1]
    rows = [("c", 0, 0, 50.0, 0.0, 60.0, 10.0, 0.9), ("c", 0, 1, 0.0, 0.0, 10.0, 10.0, 0.8), ("c", 1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), ("c", 2, 0, 0.0, 0.0, 10.0, 10.0, 0.9),
            ("c", 2, 1, 0.0, 0.0, 10.0, 10.2, 0.8), ("c", 2, 2, 70.0, 0.0, 80.0, 10.0, 0.95), ("c", 3, 0, 5.0, 0.0, 6.0, 1.0, 0.1)]
    df = spark.createDataFrame(rows, "camera string, frame int, pos int, x1 double, y1 double, x2 double, y2 double, score double")
    got = {r["frame"]: [p["pos"] for p in r["people"]] for r in detections.correct_people(df, ["camera"], "frame", 2).collect()}
    assert got == {0: [1, 0], 1: [1, 0], 2: [0, 2], 3: [0, 2]}
    vis = spark.createDataFrame([("c", 0, 1)], "camera string, rank int, subject_pos int")
    assert [r["subject"] for r in detections.assign_visible(df.filter("frame = 0"), ["camera", "frame"], vis).collect()] == [1]
    assert sorted(r["subject"] for r in detections.assign_visible(df.filter("frame = 0"), ["camera", "frame"], vis, fallback=2).collect()) == [1, 1]


def test_single_file_csv(spark, tmp_path):
    r = Results.of(spark.createDataFrame([("jpe", "a", 1.5), ("jpe", "b", float("nan"))], "metric_name string, person string, value double"))
    path = r.to_csv(str(tmp_path), "one", single=True)
    assert sorted(open(path).read().split()) == ["jpe,a,1.5", "jpe,b,", "metric_name,person,value"]


def test_feature_registry(spark):
    assert set(features.FEATURES) == {"kinematics", "proximity", "leaning", "gaze_interaction", "gaze_multiview"}
    one = spark.createDataFrame([(0, "c1", 3.0, 4.0, 0.0), (0, "c2", 3.0, 4.0, 0.0)], "frame int, camera string, x double, y double, z double")
    fused = features.FEATURES["gaze_multiview"]([one], ["frame"], ["x", "y", "z"]).first()["fused"]
    assert fused == pytest.approx([0.6, 0.8, 0.0])
    people = spark.createDataFrame([(0, "a", 0.0, 0.0, 0.0), (0, "b", 3.0, 4.0, 0.0)], "frame int, person string, x double, y double, z double")
    assert [r["distance"] for r in features.FEATURES["proximity"](people, ["frame"], ["x", "y", "z"]).collect()] == [5.0, 5.0]


def test_savgol_ends_and_gaps(spark):
    """Every place of a window by a polynomial fit; a missing value spreads; a short series is an error."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=23)
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)] + [("b", k, None if k == 9 else float(k)) for k in range(20)], "s string, frame int, x double")
    got = {(r["s"], r["frame"]): r["smoothed"] for r in temporal.savgol(df, ["s"], "x", 7, 3).collect()}
    for k in range(23):
        start = min(max(k - 3, 0), 16)
        assert got["a", k] == pytest.approx(np.polyval(np.polyfit(np.arange(7), x[start : start + 7], 3), k - start))
    assert [k for k in range(20) if got["b", k] is None] == list(range(6, 13)) and got["b", 0] == pytest.approx(0.0, abs=1e-9)
    with pytest.raises(Exception, match="shorter than the window"):
        temporal.savgol(df.filter("frame < 5"), ["s"], "x", 7, 3).collect()


def test_correct_people_above_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for frame in range(60):
        for pos in range(int(rng.integers(1, 5))):
            x, y = (float(v) for v in rng.integers(0, 5, 2) * 20)
            rows.append(("c", frame, pos, x, y, x + 10, y + 10, float(rng.integers(0, 100)) / 100))
    df = spark.createDataFrame(rows, "camera string, frame int, pos int, x1 double, y1 double, x2 double, y2 double, score double")
    assert sum(0.3 < r[-1] <= 0.7 for r in rows) > 20
    want, last = {}, []
    for frame in range(60):
        own = [r for r in rows if r[1] == frame and r[-1] > 0.3]
        if len(own) != 2 and own:
            left = kept_boxes(np.array([r[3:7] for r in own]), np.array([r[7] for r in own]), 0.9)
            own = [own[k] for k in left]
        if len(own) == 2:
            last = [r[2] for r in sorted(own, key=lambda r: (r[3], r[2]))]
        want[frame] = last
    got = {r["frame"]: [p["pos"] for p in r["people"]] for r in detections.correct_people(df, ["camera"], "frame", 2, above=0.3).collect()}
    assert got == want


def test_calibration_and_triangulation(spark):
    r = np.array([0.1, -0.4, 0.2])
    m = cameras.rodrigues(r)
    assert np.allclose(m @ m.T, np.eye(3)) and np.allclose(cameras.rotation_vector(m), r)
    assert np.allclose(cameras.rodrigues(cameras.rotation_vector(np.diag([1.0, -1, -1]))), np.diag([1.0, -1, -1]))
    k = np.array([[800.0, 0, 320], [0, 810, 240], [0, 0, 1]])
    d = np.array([0.05, -0.02, 0.001, 0.002, 0.01])
    one_, two = {"mtx": k, "rvec": [0, 0, 0], "tvec": [0, 0, 8], "dist": d},  {"K": k, "R": m, "t": [-2, 0, 9], "d": d[:4]}
    world = np.random.default_rng(0).uniform(-1, 1, (20, 3))

    def see(c):
        c = cameras.complete(c)
        x = c["R"] @ world.T + c["t"][:, None]
        u, v = x[0] / x[2], x[1] / x[2]
        k1, k2, p1, p2, k3 = c["d"]
        q = u * u + v * v
        f = 1 + k1 * q + k2 * q * q + k3 * q**3
        return np.column_stack([k[0, 0] * (u * f + 2 * p1 * u * v + p2 * (q + 2 * u * u)) + k[0, 2], k[1, 1] * (v * f + p1 * (q + 2 * v * v) + 2 * p2 * u * v) + k[1, 2]])

    rows = [(i, c, *map(float, xy), conf) for c, xys, conf in (("c1", see(one_), 0.9), ("c2", see(two), 0.7)) for i, xy in enumerate(xys)] + [(99, "c1", None, 1.0, 0.5), (99, "c2", 1.0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "i int, camera string, x double, y double, conf double")
    got = {r["i"]: r for r in cameras.triangulate_joints(df, one_, two, ("c1", "c2"), ["i"]).collect()}
    assert all(np.allclose([got[i][c] for c in "xyz"], world[i], atol=1e-5) and got[i]["conf"] == 0.7 for i in range(20))
    assert got[99]["x"] is None and got[99]["conf"] is None
    with pytest.raises(ValueError):
        cameras.complete({"K": k, "R": np.ones((3, 3)), "t": [0, 0, 0]})
    with pytest.raises(KeyError):
        cameras.complete({"K": k})


def test_head_axes_and_projection(spark):
    r = one(spark, a=cameras.head_axes(F.lit(90.0), F.lit(0.0), F.lit(-90.0), F.lit(10.0), F.lit(20.0)))["a"]
    assert np.allclose(r, [10, 20, 110, 20, 10, -30, 10, 20])
    gaze = spark.createDataFrame([(0, [0.0, 0.0, -1.0]), (1, None)], "f int, fused array<double>")
    cams = spark.createDataFrame([("c", np.eye(3).tolist(), 1000.0)], "camera string, R array<array<double>>, image_width double")
    got = {x["f"]: (x["dx"], x["dy"]) for x in fusion.project_gaze(gaze, cams, ["f"]).collect()}
    assert got == {0: (0, 0), 1: (None, None)}


def test_points_between_and_summaries(spark, tmp_path):
    pts = spark.createDataFrame([(0, "l", 0.0), (0, "r", 2.0), (1, "l", 1.0), (1, "r", None)], "f int, label string, x double")
    assert {r["f"]: r["x"] for r in fusion.mid_point(pts, ["f"], ["x"], ["l", "r"]).collect()} == {0: 1.0, 1: None}
    r = one(spark, **{f"c{k}": c for k, c in enumerate(fusion.face_centre(F.lit(None).cast("double"), F.lit(5.0), F.lit(1), F.lit(900.0), F.lit(600.0)))})
    assert (r["c0"], r["c1"]) == (600.0, 5.0)
    rows = spark.createDataFrame([("kp", "jpe", 1.0), ("cat", "f1", 0.5)], "metric_type string, metric string, value double")
    assert [p.rsplit("/", 1)[1] for p in write_metric_summaries(rows, str(tmp_path), "d")] == ["d_cat_summary.csv", "d_kp_summary.csv"]


def test_table_shapes(spark):
    assert tables.keypoint_names({"nose": 0, "eye": [1, 2], "hand": {"wrist": 3}}) == {0: "nose", 1: "eye_0", 2: "eye_1", 3: "wrist"}
    assert tables.wide_names("a", None, 1, True) == "a_1" and tables.wide_names("a", "x", 0, False) == "a_x"
    e = tables.polyline_edges(spark.createDataFrame([("arm", ["s", "e", "w"]), ("dot", ["n"])], "line string, joints array<string>"))
    assert sorted((r["start"], r["end"]) for r in e.collect()) == [("e", "w"), ("s", "e")]
    pts = spark.createDataFrame([(0, "s", 0.0), (0, "e", 1.0), (0, "w", 2.0)], "f int, label string, x double")
    assert tables.edge_points(pts, e, ["f"], ["x"]).count() == 2
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, None), (4, 3.0)], "k int, v double")
    r = tables.regression_diff(a, b, ["k"], "v").first()
    assert (r["different"], r["only_ours"], r["only_golden"], r["max_abs"]) == (0, 1, 1, 0.0)
    assert [x["k"] for x in tables.missing_keys(a, b, ["k"]).collect()] == [3]


def test_features_run_in_order(spark):
    df = spark.createDataFrame([(1,)], "x int")
    base = features.Feature("base", (("joints", "m"),), lambda i, c: i["joints", "m"].withColumn("y", F.lit(c.get("y", 0))))
    top = features.Feature("top", (("base", ""),), lambda i, c: i["base", ""].withColumn("z", F.col("y") + 1))
    got = features.run_all([top, base], {("joints", "m"): df}, {"base": {"y": 4}})
    assert got["top", ""].first()["z"] == 5
    with pytest.raises(FileNotFoundError):
        base.run({}, {})
    hooked = features.model_hook(df, lambda p: p.assign(x=p["x"] * 2), "x int")
    assert hooked.first()["x"] == 2


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.floats(-1e3, 1e3), st.floats(-1e3, 1e3)), min_size=2, max_size=6), st.floats(-100, 100), st.floats(0, 6.28))
def test_distance_is_invariant(spark, points, shift, turn):
    c, s = math.cos(turn), math.sin(turn)
    moved = [(c * x - s * y + shift, s * x + c * y - shift) for x, y in points]
    rows = [(k, list(points[0]), list(p), list(moved[0]), list(q)) for k, (p, q) in enumerate(zip(points, moved))]
    df = spark.createDataFrame(rows, "k int, a array<double>, b array<double>, c array<double>, d array<double>")
    for r in df.select(vec.distance(F.col("a"), F.col("b")).alias("x"), vec.distance(F.col("c"), F.col("d")).alias("y")).collect():
        assert abs(r["x"] - r["y"]) < 1e-6


def test_result_does_not_depend_on_partitions(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("frame"), F.sin("id").alias("x"))
    got = [sorted(map(tuple, temporal.velocity(df.repartition(n), ["k"], ["x"], 30.0).collect()), key=str) for n in (1, 7)]
    assert got[0] == got[1]


def test_axis_subset_and_label_predicate(spark):
    df = spark.createDataFrame([("left_eye", [1.0, 2.0, 3.0]), ("nose", [4.0, 5.0, 6.0])], "label string, v array<double>")
    assert [r[0] for r in df.select(align.subset_axis4(F.col("v"), [2, 0])).collect()] == [[3.0, 1.0], [6.0, 4.0]]
    assert [r["label"] for r in align.labels_containing(df, "eye").collect()] == ["left_eye"]
    wanted = spark.createDataFrame([("d1", "body"), ("d1", "face"), ("d2", "body")], "dataset string, component string")
    assert sorted(map(tuple, align.evaluation_entries(wanted, {"body": ["x", "y"]}).collect())) == [(d, "body", a) for d in ("d1", "d2") for a in "xy"]
    assert tables.work_total(wanted.selectExpr("length(dataset) AS n"), "n").first()["frames"] == 6
    assert tables.work_total(wanted.selectExpr("length(dataset) AS n").limit(0), "n").first()["frames"] == 0


def test_calibration_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(fusion, "MOST_CAMERAS", 1)
    eye = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    table = spark.createDataFrame([("a", eye, 100.0), ("b", eye, 100.0)], "camera string, R array<array<double>>, image_width double")
    with pytest.raises(Exception, match="more than 1"):
        fusion.project_gaze(spark.createDataFrame([(0, [0.0, 0.0, -1.0])], "frame int, fused array<double>"), table, ["frame"]).collect()


def two_sessions():
    """Cameras of two sessions: other matrices, distortions, and a third camera that only one has."""
    k = lambda f, c: [[f, 0.0, c], [0.0, f * 1.1, c - 20], [0.0, 0.0, 1.0]]
    return {
        ("s1", "q"): {"c1": {"K": k(800.0, 320.0), "r": [0.0, 0, 0], "t": [0.0, 0, 10], "d": [0.1, -0.05, 0.002, -0.001, 0.01]}, "c2": {"K": k(700.0, 300.0), "r": [0.0, 0.4, 0], "t": [-3.0, 0, 11]}},
        ("s2", None): {"c1": {"K": k(900.0, 400.0), "r": [0.3, 0.1, 0], "t": [1.0, 0.5, 9]}, "c2": {"K": k(650.0, 310.0), "r": [0.0, -0.5, 0.1], "t": [2.0, 0, 12], "d": [-0.2, 0.02, 0.0, 0.001, 0.0]}, "c9": {"K": k(1.0, 1.0), "r": [0.0, 0, 0], "t": [0.0, 0, 1]}},
        ("s3", "q"): {"c1": {"K": k(1.0, 1.0), "r": [0.0, 0, 0], "t": [0.0, 0, 1]}},
    }


def seen_by(camera, point):
    m = cameras.complete(camera)
    x, y, z = m["Rt"] @ np.append(point, 1)
    u, v = x / z, y / z
    k1, k2, p1, p2, k3 = m["d"]
    r2 = u * u + v * v
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    u, v = u * radial + 2 * p1 * u * v + p2 * (r2 + 2 * u * u), v * radial + p1 * (r2 + 2 * v * v) + 2 * p2 * u * v
    return float(m["K"][0, 0] * u + m["K"][0, 2]), float(m["K"][1, 1] * v + m["K"][1, 2])


@pytest.mark.parametrize("named", [None, ("c1", "c2")])
def test_triangulation_by_session(spark, tmp_path, named):
    held = two_sessions()
    path = calibration.save(tmp_path / "c.json", held)
    table = functools.reduce(lambda a, b: a.unionByName(b), (calibration.load(spark, path, "d", *key, list(own)) for key, own in held.items()))
    rng, rows, want = np.random.default_rng(0), [], {}
    for (s, q), own in held.items():
        for i in range(40):
            point = rng.normal(size=3)
            for c in own:
                gone = (i == 5 and c == "c2") or None
                x, y = seen_by(own[c], point)
                if i != 6 or c != "c2":
                    rows.append(("d", s, q, i, c, None if gone else x, y, 0.5 if c == "c1" else 0.9))
            if len(own) > 1 and i != 6:
                want[s, q, i] = None if i == 5 else point
    df = spark.createDataFrame(rows, "dataset string, session string, sequence string, frame int, camera string, x double, y double, conf double")
    got = {(r["session"], r["sequence"], r["frame"]): r for r in cameras.triangulate_sessions(df, table, ["frame"], ["dataset", "session", "sequence"], named).collect()}
    assert got.keys() == want.keys()
    for k, point in want.items():
        r = got[k]
        assert (r["x"] is None and r["conf"] is None) if point is None else (np.allclose([r["x"], r["y"], r["z"]], point, atol=1e-5) and r["conf"] == 0.5)


def test_projection_by_session(spark):
    eye, turn = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [[0.0, 0.0, 1.0], [0.0, 1.0, 0.0], [-1.0, 0.0, 0.0]]
    table = spark.createDataFrame([("s1", "c1", eye, 100.0), ("s1", "c2", turn, 200.0), (None, "c1", turn, 500.0), ("s4", "c1", eye, 1.0)], "session string, camera string, R array<array<double>>, image_width double")
    gaze = spark.createDataFrame([("s1", 0, [0.6, 0.0, -0.8]), (None, 1, [0.6, 0.0, -0.8]), (None, 2, None), ("s3", 3, [1.0, 0.0, 0.0])], "session string, frame int, fused array<double>")
    got = {(r["session"], r["frame"], r["camera"]): r["dx"] for r in fusion.project_gaze(gaze, table, ["frame"], session=["session"]).collect()}
    one = {(r["frame"], r["camera"]): r["dx"] for r in fusion.project_gaze(gaze, table.filter("session = 's1'"), ["frame"]).collect()}
    assert got.keys() == {("s1", 0, "c1"), ("s1", 0, "c2"), (None, 1, "c1"), (None, 2, "c1")}
    assert got["s1", 0, "c1"] == one[0, "c1"] and got["s1", 0, "c2"] == one[0, "c2"] and got[None, 2, "c1"] is None


def test_general_inverse(spark):
    rng = np.random.default_rng(5)
    ms = [rng.normal(size=(3, 3)) * 10.0 ** rng.integers(-3, 4) for _ in range(30)] + [cameras.rodrigues(rng.normal(size=3)) for _ in range(5)]
    flat = [np.outer([1.0, 2, 3], [4.0, 5, 6]), np.zeros((3, 3)), np.array([[1.0, 2, 3], [2, 4, 6], [0, 1, 5]])]
    df = spark.createDataFrame([(k, m.tolist()) for k, m in enumerate([*ms, *flat])], "i int, m array<array<double>>")
    v = F.array(F.lit(1.0), F.lit(-2.0), F.lit(0.5))
    got = {r["i"]: r for r in df.select("i", vec.inverse3(F.col("m")).alias("inv"), vec.is_rotation(F.col("m")).alias("rot"), cameras.world_direction(F.col("m"), v).alias("w")).collect()}
    for k, m in enumerate(ms):
        inv = np.linalg.inv(m)
        w = inv @ [1.0, -2.0, 0.5]
        assert np.allclose(got[k]["inv"], inv, rtol=1e-8) and np.allclose(got[k]["w"], w / np.linalg.norm(w)) and got[k]["rot"] == (k >= 30)
    assert all(got[len(ms) + k]["inv"] is None and got[len(ms) + k]["w"] is None for k in range(3))


def test_suppression_is_one_aggregation(spark):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for f in range(60):
        n = int(rng.integers(0, 7))
        low = rng.integers(0, 8, (n, 2)).astype(float)
        boxes, scores = np.hstack([low, low + rng.integers(0, 12, (n, 2))]), rng.integers(1, 4, n) / 4
        rows += [(f % 3 or None, f, p, *map(float, b), float(s), "x") for p, (b, s) in enumerate(zip(boxes, scores))]
        want[f] = kept_boxes(boxes, scores, 0.4)
    df = spark.createDataFrame(rows, "camera int, frame int, pos int, x1 double, y1 double, x2 double, y2 double, score double, extra string").repartition(7)
    out = detections.suppress_overlaps(df, ["camera", "frame"], 0.4)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["pos"]):
        got.setdefault(r["frame"], []).append(r["pos"])
    assert out.columns == df.columns and got == {f: k for f, k in want.items() if k}
    n, plan = exchanges(out)
    assert n <= 2 and "Python" not in plan and "Pandas" not in plan and "Join" not in plan  # one is the test's own repartition
    people = detections.correct_people(df, ["camera"], "frame", 2, above=0.2, threshold=0.4)
    n, plan = exchanges(people)
    assert n <= 3 and "Python" not in plan and "Join" not in plan
    as_text = lambda d: sorted(str(r) for r in d.collect())
    assert as_text(people) == as_text(detections.correct_people(df, ["camera"], "frame", 2, above=0.2, threshold=0.4, block=8))


def test_pairs_scan_once(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0), (None, "a", 4.0), (None, "b", 5.0), (3, "a", 1.0), (3, "b", 2.0), (3, "c", 3.0)], "frame int, person string, x double")
    out = dyads.pairs(df, ["frame"], "person", ["x"])
    assert exchanges(out)[0] == 1
    assert sorted((r["frame"], r["person_a"], r["person_b"]) for r in out.collect()) == sorted([(1, "a", "b"), (1, "b", "a"), *((3, a, b) for a, b in itertools.permutations("abc", 2))])
    assert {r["frame"] for r in dyads.pairs(df, ["frame"], "person", ["x"], only_dyads=True).collect()} == {1}
