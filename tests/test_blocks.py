"""Series in blocks give the rows of the window form."""

import random

import pytest
from pyspark.sql import functions as F

from kinelattice.operators import temporal


def frames(rng, n, gaps, step):
    """Series of many lengths, with frames and values missing; names that operators use themselves are absent from tables."""
    rows = []
    for s in range(n):
        at = rng.randint(-20, 20)
        for _ in range(rng.choice([11, 12, 30, 200, 500])):
            at += 1 if rng.random() < 0.9 else rng.randint(1, step)
            x = None if rng.random() < gaps else round(rng.uniform(-5, 5), 3)
            rows.append((None if s == 1 else s, at, x, None if x is None or rng.random() < 0.1 else rng.random(), rng.random(), "ab"[s % 2]))
        if rng.random() < 0.5:  # a long stretch without a value
            rows += [(None if s == 1 else s, at + k, None, None, 0.1, "ab"[s % 2]) for k in range(1, 90)]
    return rows


@pytest.fixture(scope="module", params=[(0.0, 3), (0.2, 40), (0.9, 200)])
def table(spark, request):
    rows = frames(random.Random(int(request.param[0] * 10)), 9, *request.param)
    return spark.createDataFrame(rows, "s int, frame int, x double, y double, conf double, label string").repartition(5)


def limits(spark):
    return spark.createDataFrame([("a", 0.004)], "label string, limit double")


OPS = {
    "displacement": lambda d, b: temporal.displacement(d, ["s"], ["x", "y"], block=b),
    "adjacent": lambda d, b: temporal.displacement(d, ["s"], ["x"], gaps="frame", block=b),
    "velocity": lambda d, b: temporal.velocity(d, ["s"], ["x", "y"], 30.0, "conf", block=b),
    "jumps": lambda d, b: temporal.jump_flags(d, ["s", "label"], ["x"], limits(d.sparkSession), "label", "limit", block=b),
    "gradient": lambda d, b: temporal.gradient(d, ["s"], "x", block=b),
    "savgol": lambda d, b: temporal.savgol(d, ["s"], "x", block=b),
    "interpolate": lambda d, b: temporal.interpolate(d, ["s"], ["x", "y"], block=b),
    "compat": lambda d, b: temporal.interpolate(d, ["s"], ["x", "y"], compat=True, block=b),
    "carry": lambda d, b: temporal.carry_forward(d, ["s"], "x", F.col("conf") > 0.7, block=b),
}


def rows(df):
    return sorted((str(r.asDict()) for r in df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", list(OPS))
def test_equal_to_the_window_form(table, name):
    want = OPS[name](table, None)
    cells = [c for c, t in want.dtypes if t == "double"]
    rounded = lambda df: df.withColumns({c: F.round(c, 9) for c in cells})
    expected = rows(rounded(want))
    for block in (1, 7, 64):
        got = OPS[name](table, block)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(rounded(got)) == expected, block


def test_one_long_series_is_spread(spark):
    """A single series takes part in every task of the last stage, and no window partition is longer than a block and its halo."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(200_000).select(F.lit(1).alias("s"), F.col("id").cast("int").alias("frame"), (F.col("id") % 977).cast("double").alias("x"))
        per_task = lambda out, c: [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum(c)).collect()]
        holes = df.withColumn("x", F.when(F.col("frame") % 5 > 0, F.col("x")))
        for n in (per_task(temporal.savgol(df, ["s"], "x", block=1024), "smoothed"), per_task(temporal.interpolate(holes, ["s"], ["x"], block=1024), "x")):
            assert len(n) == 4 and max(n) < 100_000 and sum(n) == 200_000
        assert len(per_task(temporal.savgol(df, ["s"], "x"), "smoothed")) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
