"""Comparison of two roots of archives."""

import json
import shutil

import numpy as np
import pytest

from kinelattice.operators import comparison


def save(path, compressed=False, **arrays):
    path.parent.mkdir(parents=True, exist_ok=True)
    known = {k: {"axis0": ["p"] * v.shape[0], "axis3": ["x", "y"]} for k, v in arrays.items()}
    (np.savez_compressed if compressed else np.savez)(path, **arrays, data_description=np.array(json.dumps(known)))


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    root = tmp_path_factory.mktemp("roots")
    rng = np.random.default_rng(2)
    arrays = {n: rng.normal(size=(2, 1, 50, 2)).astype(np.float32) for n in ("same", "noise", "nan", "shape", "type", "gone")} | {"ints": np.arange(8).reshape(2, 1, 2, 2)}
    arrays["nan"][0, 0, 3, 1] = np.nan
    a, b = root / "a" / "d__s1" / "body_joints", root / "b" / "d__s1" / "body_joints"
    save(b / "net.npz", **arrays)
    other = {k: v.copy() for k, v in arrays.items() if k != "gone"} | {"new": np.zeros((1, 1, 1, 2))}
    other["noise"][1, 0, 4:6, 0] += [0.5, -0.25]
    other["nan"][1, 0, 7, 0] = np.nan
    other["shape"] = other["shape"][:, :, :49]
    other["type"] = other["type"].astype(np.float64)
    other["ints"][0, 0, 0, 0] += 3
    save(a / "net.npz", compressed=True, **other)
    for side, name in ((a, "extra"), (b, "lost"), (a, "twin"), (b, "twin"), (b, "config_x")):
        save(side / f"{name}.npz", v=arrays["same"])
    (a / "broken.npz").write_bytes(b"no archive")
    save(b / "broken.npz", v=arrays["same"])
    return str(root / "a"), str(root / "b"), arrays, other


@pytest.mark.parametrize("verify", [False, True])
def test_differences(spark, roots, verify):
    ours, golden, before, after = roots
    rows = comparison.compare_roots(spark, ours, golden, ignore=("config_",), verify=verify).collect()
    got = {(r["file"].split("/")[-1], r["array_name"], r["problem"]): r for r in rows}
    assert len(got) == len(rows) and set(got) == {
        ("extra.npz", None, "extra file"), ("lost.npz", None, "missing file"), ("broken.npz", None, "unreadable"), ("broken.npz", "v", "missing array"), ("net.npz", "gone", "missing array"), ("net.npz", "new", "extra array"),
        ("net.npz", "shape", "shape"), ("net.npz", "type", "type"), ("net.npz", "noise", "values"), ("net.npz", "nan", "values"), ("net.npz", "ints", "values"),
    }
    assert got["net.npz", "shape", "shape"]["ours"] == "[2, 1, 49, 2]" and got["net.npz", "shape", "shape"]["golden"] == "[2, 1, 50, 2]"
    for name, n in (("noise", 2), ("nan", 1)):
        d = (after[name].astype(float) - before[name]).ravel()
        r = got["net.npz", name, "values"]
        assert r["different"] == n and [r["max_abs"], r["mean_abs"], r["std_diff"]] == pytest.approx([np.nanmax(abs(d)), np.nanmean(abs(d)), np.nanstd(d)], abs=1e-12)
    assert got["net.npz", "ints", "values"]["different"] == 1 and got["net.npz", "ints", "values"]["max_abs"] is None


def test_equal_roots_are_not_read(spark, roots, tmp_path, monkeypatch):
    shutil.copytree(roots[1], tmp_path / "copy")
    assert comparison.compare_roots(spark, str(tmp_path / "copy"), roots[1], verify=True).count() == 0
    seen = []
    monkeypatch.setattr(comparison, "value_sums", lambda pairs, *a: seen.append(pairs.count()) or pairs.sparkSession.createDataFrame([], comparison._SUMS))
    assert comparison.compare_roots(spark, str(tmp_path / "copy"), roots[1]).count() == 0 and seen == [0]


def test_parts_add_up(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1, 1, 9000, 2)) * 1e3 + 1e5
    y = x + rng.normal(size=x.shape)
    save(tmp_path / "a" / "d__s" / "c" / "n.npz", v=x, f=np.asfortranarray(x))
    save(tmp_path / "b" / "d__s" / "c" / "n.npz", v=y, f=y)
    pairs = spark.createDataFrame([("d__s/c/n.npz", "v", 18000), ("d__s/c/n.npz", "f", 18000)], "file string, array_name string, n long")
    held = comparison._PART
    comparison._PART = 1000
    try:
        parts = comparison.value_sums(pairs, str(tmp_path / "a"), str(tmp_path / "b"), 1e-5, 1e-8).collect()
    finally:
        comparison._PART = held
    for name in "vf":
        own = [r for r in parts if r["array_name"] == name]
        assert len(own) == 18 and sum(r["n"] for r in own) == 18000 and sum(r["total"] for r in own) == pytest.approx(abs(x - y).sum())
    row = {r["array_name"]: r for r in comparison.compare_roots(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()}
    assert row["v"]["std_diff"] == pytest.approx((x - y).std()) and row["f"]["std_diff"] == pytest.approx((x - y).std())
