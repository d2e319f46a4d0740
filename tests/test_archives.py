"""Split and pruned archive reads, and axes from headers."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from kinelattice.sources import npz


class Counted(io.BytesIO):
    """A file that counts the bytes read from it."""

    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


def fill(root, frames=9000, compressed=False, fortran=False):
    folder = root / "data__s1__q1" / "body_joints"
    folder.mkdir(parents=True)
    axes = {"axis0": ["p1", "p2"], "axis1": ["c1", "c2"], "axis2": [f"{k:09d}" for k in range(10, 10 + frames)], "axis3": ["nose", "hip", "knee"], "axis4": ["x", "y", "confidence_score"]}
    data = np.random.default_rng(1).random((2, 2, frames, 3, 3)).astype(np.float32)
    other = {"axis0": ["p1"], "axis1": ["c1"], "axis2": ["5", "6"], "axis3": ["a", "b"]}
    arrays = {"2d": np.asfortranarray(data) if fortran else data, "4d": np.ones((1, 1, 2, 2)), "unnamed": np.zeros(3), "data_description": np.array(json.dumps({"2d": axes, "4d": other, "note": 3}))}
    (np.savez_compressed if compressed else np.savez)(folder / "alg.npz", **arrays)
    return str(folder / "alg.npz"), data


@pytest.mark.parametrize("compressed, fortran", [(False, False), (True, False), (False, True)])
def test_parts_hold_every_row_once(spark, tmp_path, compressed, fortran):
    _, data = fill(tmp_path, compressed=compressed, fortran=fortran)
    for split in (1 << 14, 1 << 30):
        df = npz.read_npz(spark, str(tmp_path), split)
        rows = df.filter("array_name = '2d'").select("person", "camera", "frame", "frame_idx", "label", "v", "conf").collect()
        assert len(rows) == data[..., 0].size == len({tuple(r)[:5] for r in rows})
        for r in rows[::997]:
            want = data[int(r["person"][1]) - 1, int(r["camera"][1]) - 1, r["frame"] - 10, ["nose", "hip", "knee"].index(r["label"])]
            assert np.allclose([*r["v"], r["conf"]], want) and r["frame_idx"] == r["frame"] - 10
        assert df.filter("array_name = '4d'").count() == 2
        some = df.filter("person = 'p2' and camera = 'c1' and frame >= 500 and frame < 503 and label = 'hip'").orderBy("frame").collect()
        assert [r["frame"] for r in some] == [500, 501, 502] and np.allclose([r["conf"] for r in some], data[1, 0, 490:493, 1, 2])
        assert df.filter("frame in (12, 400, 9009) and array_name = '2d'").count() == 3 * 12
        assert df.filter("session = 's2'").count() == 0


def test_many_partitions(spark, tmp_path):
    fill(tmp_path)
    assert npz.read_npz(spark, str(tmp_path), 1 << 15).rdd.getNumPartitions() > 30


def test_only_the_wanted_bytes_are_read(tmp_path):
    path, data = fill(tmp_path)
    raw = open(path, "rb").read()

    def rows(*filters):
        reader = npz.NpzReader({"path": path})
        assert list(reader.pushFilters(list(filters))) == []
        file = Counted(raw)
        with zipfile.ZipFile(file) as z:
            blocks = reader._blocks(z, npz._described(path))
            before, member = file.taken, npz.Member(z, "2d")
            got = [member.frames(*b[1:5]) for b in blocks]
            return file.taken - before, member.taken, sum(map(len, got))

    whole = data.nbytes
    read, taken, n = rows(EqualTo(("array_name",), "2d"), GreaterThanOrEqual(("frame",), 100), LessThan(("frame",), 190))
    assert n == 4 * 90 and taken == whole // 100 and read < taken + 4 * (1 << 16)
    read, taken, n = rows(EqualTo(("array_name",), "2d"), In(("person",), ("p2",)), EqualTo(("camera",), "c2"), EqualTo(("frame",), 77))
    assert n == 1 and taken == whole // data[..., 0, 0].size and read < 1 << 17


def test_axes_from_headers(spark, tmp_path):
    path, data = fill(tmp_path, 30)
    (tmp_path / "data__s1__q1" / "body_joints" / "broken.npz").write_bytes(b"no archive")
    np.savez(tmp_path / "data__s1__q1" / "body_joints" / "short.npz", **{"3d": np.zeros((1, 1, 3)), "data_description": np.array(json.dumps({"3d": {"axis0": ["p"], "axis1": ["c"], "axis2": ["1", "2"]}}))})
    rows = {(r["algorithm"], r["array_name"]): r for r in npz.read_axes(spark, str(tmp_path)).collect()}
    two = rows[("alg", "2d")]
    assert two["shape"] == list(data.shape) and two["axis3"] == ["nose", "hip", "knee"] and len(two["axis2"]) == 30 and two["problem"] is None
    assert rows[("alg", "4d")]["axis4"] is None and rows[("alg", "unnamed")]["problem"] == "no description"
    assert rows[("broken", None)]["problem"] == "no readable description" and "differ" in rows[("short", "3d")]["problem"]
    assert npz.read_axes(spark, str(tmp_path)).filter("algorithm = 'alg' and array_name = '4d'").count() == 1


VALUES = "metric_name string, dataset string, session string, sequence string, component string, algorithm string, metric_type string, person string, camera string, frame int, label string, value double"


def long_rows(n):
    """A sparse grid: a few cells of many people, frames and labels; some with no value; two metrics in one file."""
    rng = np.random.default_rng(4)
    rows = {}
    for _ in range(n):
        key = ("jpe" if rng.random() < 0.8 else "pck", "d", f"s{rng.integers(3)}", None if rng.random() < 0.5 else "q", "body_joints", "alg", "point_cloud_metrics", f"p{rng.integers(5)}", f"c{rng.integers(2)}", int(rng.integers(0, 4000)), f"l{rng.integers(40)}")
        rows[key] = None if rng.random() < 0.1 else float(rng.integers(0, 1000))
    return [(*k, v) for k, v in rows.items()]


def test_streamed_grids(spark, tmp_path):
    rows = long_rows(3000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        out = npz.write_npz(spark.createDataFrame(rows, VALUES).repartition(6), str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = {r["path"]: r["arrays"] for r in out}
    assert len(files) == 6 and not (tmp_path / "_temporary").exists()
    want = {}
    for r in rows:
        folder = "__".join(x for x in r[1:4] if x)
        want.setdefault((f"{tmp_path}/{folder}/body_joints/alg__point_cloud_metrics.npz", r[0]), {})[r[7:11]] = r[11]
    for (path, metric), own in want.items():
        known, grid = npz.description(path)[metric], np.load(path)[metric]
        axes = [sorted({k[j] for k in own}) for j in range(4)]
        assert [known["axis0"], known["axis1"], [int(x) for x in known["axis2"]], known["axis3"]] == axes and grid.dtype == np.float32
        full = np.full([len(a) for a in axes], np.nan, np.float32)
        for k, v in own.items():
            full[tuple(a.index(x) for a, x in zip(axes, k))] = np.nan if v is None else v
        assert np.array_equal(full, grid, equal_nan=True)
        assert files[path] == len(set(np.load(path).files) - {"data_description"})


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    rows = spark.createDataFrame(long_rows(500), VALUES)
    bad = rows.withColumn("value", F.when(F.col("session") == "s2", F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="stop"):
        npz.write_npz(bad, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").rglob("*.npz")) == []
    npz.write_npz(rows.limit(0), str(tmp_path / "none"))


def test_features_round_trip(spark, tmp_path):
    path, data = fill(tmp_path / "a", 700, compressed=True)
    rows = npz.read_npz(spark, str(tmp_path / "a"))
    npz.write_features(rows, str(tmp_path / "b")).collect()
    assert sorted(map(str, npz.read_npz(spark, str(tmp_path / "b")).drop("path").collect())) == sorted(map(str, rows.drop("path").collect()))
