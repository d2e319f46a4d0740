"""Late and shuffled frames give the batch answer, and idle state goes."""

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelattice.operators import temporal
from kinelattice.streaming import ordered

SCHEMA = "series string, ts timestamp, frame int, x double, y double, z double"
START = dt.datetime(2024, 1, 1)


def frames(rng, series, n, step=1.0):
    out = []
    for k in range(n):
        at = [None if rng.random() < 0.05 else float(rng.randint(0, 9)) for _ in range(3)]
        if rng.random() < 0.9:
            out.append((series, START + dt.timedelta(seconds=k * step), k, *at))
    return out


def play(spark, tmp_path, batches, name, **options):
    """Write every batch as a file of its own and run the stream over them, one file at a time; (rows, progress reports)."""
    folder = tmp_path / "in"
    folder.mkdir()
    for k, rows in enumerate(batches):
        df = pd.DataFrame(rows, columns=["series", "ts", "frame", "x", "y", "z"]).astype({"frame": "int32", "x": float, "y": float, "z": float})
        df["ts"] = df["ts"].astype("datetime64[us]").dt.tz_localize("UTC")
        path = folder / f"{k:04d}.parquet"
        df.to_parquet(path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.STORE)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
        out = ordered.ordered_jumps(stream, 5.0, **options)
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(300) is not False
        return spark.table(name).collect(), q.recentProgress
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_frames_give_the_batch_answer(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = frames(rng, "a", 60) + frames(rng, "b", 45)
    late = sorted(rows, key=lambda r: (r[1] - START).total_seconds() + rng.uniform(0, 8))  # out of order by less than the delay
    batches = [late[k : k + 13] for k in range(0, len(late), 13)]
    batches += [[("end", START + dt.timedelta(seconds=500 + k), k, 0.0, 0.0, 0.0)] for k in range(2)]  # moves the watermark on
    got, progress = play(spark, tmp_path, batches, f"shuffled{seed}", delay="10 seconds", idle_seconds=60)
    df = spark.createDataFrame(rows, SCHEMA)
    moved = temporal.displacement(df, ["series"], ["x", "y", "z"])
    want = {(r["series"], r["frame"]): r["m"] for r in moved.select("series", "frame", F.sqrt(F.col("d_x") ** 2 + F.col("d_y") ** 2 + F.col("d_z") ** 2).alias("m")).collect()}
    first = {s: min(r[2] for r in rows if r[0] == s) for s in "ab"}
    own = {(r["series"], r["frame"]): r for r in got if r["series"] != "end"}
    assert len(own) == len([r for r in got if r["series"] != "end"]) == len(rows)
    for k, r in own.items():
        assert (r["moved"] is None or r["moved"] != r["moved"]) if want[k] is None else r["moved"] == pytest.approx(want[k])
        assert r["jump"] == (None if k[1] == first[k[0]] else want[k] is not None and want[k] > 5.0)
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 6  # what is left belongs to the last series


def test_a_silent_series_starts_anew(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    batches = [[("a", at(0), 0, 0.0, 0.0, 0.0), ("a", at(1), 1, 9.0, 0.0, 0.0)], [("x", at(300), 0, 0.0, 0.0, 0.0)], [("x", at(301), 1, 0.0, 0.0, 0.0)], [("a", at(400), 50, 0.0, 0.0, 0.0)], [("x", at(900), 2, 0.0, 0.0, 0.0)], [("x", at(901), 3, 0.0, 0.0, 0.0)]]
    got, _ = play(spark, tmp_path, batches, "silent", delay="10 seconds", idle_seconds=60)
    assert sorted((r["frame"], r["jump"]) for r in got if r["series"] == "a" and r["jump"] is not None) == [(1, True)]
    assert [r["jump"] for r in got if r["series"] == "a" and r["frame"] == 50] == [None]
