"""Archives, configuration, frames, calibration and streaming."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelattice.operators.results import Results
from kinelattice.sources import calibration, config, frames, npz
from kinelattice.streaming import jumps


def archive(root, pickled=False):
    folder = root / "data__s1__q1" / "body_joints"
    folder.mkdir(parents=True)
    known = {"3d": {"axis0": ["p1", "p2"], "axis1": ["3d"], "axis2": ["000000005", "000000006"], "axis3": ["nose", "hip"], "axis4": ["x", "y", "z", "confidence_score"]}}
    data = np.arange(2 * 1 * 2 * 2 * 4, dtype=np.float32).reshape(2, 1, 2, 2, 4)
    data[0, 0, 0, 0, 1] = np.nan
    described = np.array(known, dtype=object) if pickled else np.array(json.dumps(known))
    np.savez(folder / "alg.npz", **{"3d": data, "unknown": data, "data_description": described})
    return data


@pytest.mark.parametrize("pickled", [False, True])
def test_npz_scan(spark, tmp_path, pickled):
    data = archive(tmp_path, pickled)
    df = npz.read_npz(spark, str(tmp_path))
    rows = df.filter("array_name = '3d'").collect()
    assert len(rows) == 8 and {r["array_name"] for r in rows} == {"3d"}
    r = next(r for r in rows if (r["person"], r["frame"], r["label"]) == ("p2", 6, "hip"))
    assert r["v"] == data[1, 0, 1, 1, :3].tolist() and r["conf"] == data[1, 0, 1, 1, 3] and r["frame_idx"] == 1
    assert (r["dataset"], r["session"], r["sequence"], r["component"], r["algorithm"]) == ("data", "s1", "q1", "body_joints", "alg")
    assert next(r for r in rows if (r["person"], r["frame"], r["label"]) == ("p1", 5, "nose"))["v"][1] is None
    assert df.filter("component = 'other'").count() == 0
    with pytest.raises(KeyError):
        npz.read_array(str(next(tmp_path.rglob("*.npz"))), "absent")
    with pytest.raises(Exception, match="no .npz"):
        npz.read_npz(spark, str(tmp_path / "nothing")).count()


def test_pickles_are_restricted(tmp_path):
    import os

    class Evil:
        def __reduce__(self):
            return os.system, ("true",)

    path = tmp_path / "x.npz"
    np.savez(path, data_description=np.array({"a": Evil()}, dtype=object))
    with pytest.raises(Exception, match="not admitted"):
        npz.description(str(path))


def test_npz_round_trip(spark, tmp_path):
    rows = [(m, "d", "s", None, "body", "alg", "kp", p, "c", f, l, float(f) + len(l)) for m in ("jpe", "pck") for p in ("a", "b") for f in (3, 4) for l in ("nose", "hip")]
    schema = "metric_name string, dataset string, session string, sequence string, component string, algorithm string, metric_type string, person string, camera string, frame int, label string, value double"
    df = spark.createDataFrame(rows[:-1], schema)
    paths = npz.write_npz(df, str(tmp_path)).collect()
    assert [(r["path"].endswith("d__s/body/alg__kp.npz"), r["arrays"]) for r in paths] == [(True, 2)]
    back = npz.long_values(npz.read_npz(spark, str(tmp_path)))
    assert back.count() == 16 and back.filter("value is null").count() == 1
    view = Results.of(back).query(metric_name="jpe")
    assert view.aggregate("person").count() == 2


def test_feature_archives_round_trip(spark, tmp_path):
    rows = [("d", "s", q, "kinematics", "vel", a, p, "c1", f, x, [float(f), float(len(x)), None if f == 4 else 1.0], 0.5 if a == "sure" else None, ["x", "y", "z"]) for q in (None, "q1") for a in ("sure", "plain") for p in ("a", "b") for f in (3, 4) for x in ("nose", "hip")]
    schema = "dataset string, session string, sequence string, component string, algorithm string, array_name string, person string, camera string, frame int, label string, v array<double>, conf double, axis array<string>"
    done = npz.write_features(spark.createDataFrame(rows, schema), str(tmp_path)).collect()
    assert sorted(r["path"].removeprefix(str(tmp_path)) for r in done) == ["/d__s/kinematics/vel.npz", "/d__s__q1/kinematics/vel.npz"]
    back = npz.read_npz(spark, str(tmp_path))
    assert sorted(map(str, map(tuple, back.select(*(c.split(" ")[0] for c in schema.split(", "))).collect()))) == sorted(map(str, rows))
    assert {r["sequence"] for r in npz.long_values(back, joined=True).select("sequence").collect()} == {"s", "s__q1"}
    assert "session" not in npz.long_values(back, joined=True).columns


def test_npz_round_trip_keeps_labels(spark, tmp_path):
    rows = [("jpe", "d", "s", None, "body", "alg", "kp", p, c, f, l, float(k)) for k, (p, c, f, l) in enumerate(itertools.product("ab", ("c1", "c2"), (3, 4), ("nose", "hip", "knee")))]
    schema = "metric_name string, dataset string, session string, sequence string, component string, algorithm string, metric_type string, person string, camera string, frame int, label string, value double"
    npz.write_npz(spark.createDataFrame(rows, schema), str(tmp_path)).collect()
    arrays = npz.read_npz(spark, str(tmp_path))
    back = npz.long_values(arrays)
    columns = [c.split(" ")[0] for c in schema.split(", ")]
    assert sorted(map(str, map(tuple, back.select(*columns).collect()))) == sorted(map(str, rows))
    view = Results.of(back)
    assert "label" in view.levels and view.query(label="hip").view.count() == 8
    assert view.aggregate(["label"]).count() == 3
    axis = spark.createDataFrame([(0, "x"), (1, "y")], "pos int, label string")
    assert {(r["pos"], r["label"]) for r in npz.long_values(arrays, axis).collect()} == {(0, "x"), (1, "y"), (2, "nose")}


def test_placeholders():
    got = config.resolve({"v1": "a", "v2": "<v1>b", "v3": "<v2>c", "v4": {"x": ["<v3>d", 1]}})
    assert got["v4"] == {"x": ["abcd", 1]}
    assert config.resolve({"p": "<t>/<cam>"}, {"t": "x"}, frozenset({"cam"}))["p"] == "x/<cam>"
    assert config.placeholders({"a": ["<x>", {"b": "<y>"}]}) == {"x", "y"}
    source = {"a": "<b>", "b": "1"}
    config.resolve(source)
    assert source == {"a": "<b>", "b": "1"}
    for bad in ({"a": "<b>", "b": "<a>"}, {"a": "<a>"}, {"a": "<missing>"}):
        with pytest.raises(ValueError):
            config.resolve(bad)
    with pytest.raises(KeyError):
        config.merge({"a": 1}, {"a": 2})


def test_config_files(tmp_path):
    (tmp_path / "config_1.toml").write_text('root = "r"\nout = "<root>/<run>"\n')
    (tmp_path / "config_2.toml").write_text("x = 1\n")
    assert config.latest_config(tmp_path).name == "config_2.toml"
    loader = config.ConfigLoader({"today": "d"}, {"run"})
    loaded = loader.load_config(tmp_path / "config_1.toml")
    assert loaded["out"] == "r/<run>" and loader.resolve(loaded, {"run": "7"})["out"] == "r/7"
    with pytest.raises(ValueError):
        config.load_toml(tmp_path / "x.json")
    assert config.inherit({"framework": "f", "a": 1}, {"f": {"a": 2}})["a"] == 2
    assert config.upstream("c", {"c": ["b"], "b": ["a"]}) == ["a", "b"]
    with pytest.raises(ValueError):
        config.upstream("a", {"a": ["b"], "b": ["a"]})
    noted: list[str] = []
    with config.error_scope(config.Scope.VIDEO, noted, "v1"):
        raise RuntimeError("x")
    assert noted == ["video v1: RuntimeError: x"]
    with pytest.raises(RuntimeError), config.error_scope(config.Scope.STRICT, noted, "v1"):
        raise RuntimeError("x")
    assert json.loads(config.snapshot({"a": 1}, tmp_path / "s/c.json").read_text()) == {"a": 1}
    assert config.between(1, 0, 2) == 1
    with pytest.raises(ValueError):
        config.one_of("x", ["a"])


def test_frames(spark, tmp_path):
    for f in (0, 1, 3):
        (tmp_path / f"c1_{f:09d}.png").write_text("x")
    paths = frames.image_paths(spark, ["c1"], ["c1", "c2"], 0, 4, f"{tmp_path}/%s_%09d.png")
    got = frames.existing(paths, frames.listing(spark, str(tmp_path), ".png")).orderBy("frame").collect()
    assert [r["path"] is not None for r in got] == [True, True, False, True]
    assert frames.by_frame(paths).count() == 4 and frames.by_camera(paths).first()["images"][3].endswith("000000003.png")
    assert [len(r["frames"]) for r in frames.batches(paths, 3).orderBy("batch").collect()] == [3, 1]
    with pytest.raises(ValueError):
        frames.batches(paths, 0)
    with pytest.raises(ValueError):
        frames.image_paths(spark, ["zz"], ["c1"], 0, 1, "%s%d")
    assert frames.resolve_length(3, -1, 10) == 7
    with pytest.raises(ValueError):
        frames.resolve_format(video=True, images=True)


def test_probe(spark):
    probe = {"streams": [{"codec_type": "audio"}, {"codec_type": "video", "codec_name": "h264", "avg_frame_rate": "30000/1001", "width": 10, "height": 20}], "format": {"duration": "2.0"}}
    r = frames.video_properties(spark.createDataFrame([(json.dumps(probe),), ('{"streams": []}',)], "probe string")).collect()
    assert abs(r[0]["fps"] - 29.97) < 0.01 and r[0]["n_frames"] == 59 and r[0]["duration"] == 2.0 and r[1]["fps"] is None


def test_calibration(spark, tmp_path):
    cam = {"mtx": [[800.0, 0, 1], [0, 800, 2], [0, 0, 1]], "rvec": [0, 0, 0], "tvec": [1, 2, 3], "image_size": [10, 20]}
    path = calibration.save(tmp_path / "c.json", {("s1", None): {"c1": cam}})
    r = calibration.load(spark, path, "d", "s1", None, ["c1"]).first()
    assert r["image_size"] == [10, 20] and r["P"][0] == [800.0, 0.0, 1.0, 803.0]
    for session, cams in (("zz", ["c1"]), ("s1", ["c9"])):
        with pytest.raises(KeyError):
            calibration.load(spark, path, "d", session, None, cams)


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", t, float(100 * (t == 3)), 0.0, 0.0) for t in range(6)]
    schema = "series string, frame int, x double, y double, z double"
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = jumps.jumps(stream, 50.0).writeStream.format("memory").queryName("jumped").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r["frame"]: r["jump"] for r in spark.table("jumped").collect()}
    assert got == {0: None, 1: False, 2: False, 3: True, 4: True, 5: False}


def test_segments_and_json(spark, tmp_path):
    (tmp_path / "s.csv").write_text("file,start,end\na.mp4,0.5,2\nb.mp4,1,\n")
    assert [tuple(r) for r in config.segments(spark, str(tmp_path / "s.csv")).orderBy("file").collect()] == [("a.mp4", 0.5, 2.0), ("b.mp4", 1.0, None)]
    (tmp_path / "x.json").write_text('{"a": [1]}')
    assert config.load_json(tmp_path / "x.json") == {"a": [1]}
    with pytest.raises(ValueError):
        config.load_json(tmp_path / "s.csv")


def test_real_frames(spark):
    images = spark.range(1, 5).withColumnRenamed("id", "n")
    assert sorted(r["frame"] for r in frames.real_frames(images, 100, 4).collect()) == [100, 101, 102, 103]
    with pytest.raises(AssertionError, match="5 frames"):
        frames.real_frames(images, 100, 5)


def test_integer_fps_and_paths(spark):
    df = spark.createDataFrame([("a", 29.97), ("b", None)], "path string, fps double")
    assert [r[0] for r in df.select(frames.integer_fps(F.col("fps"))).collect()] == [29, -1]
    paths = spark.createDataFrame([("a", 7, 0, "c1")], "path string, frame int, frame_idx int, camera string")
    assert [(r["path"], r["frame"]) for r in frames.rows_by_path(df, paths).collect()] == [("a", 7)]
