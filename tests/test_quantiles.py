"""Exact quantiles against sorting every group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelattice.operators.quantiles import exact_quantiles


def groups(rng):
    yield "uniform", rng.random(3000)
    yield "skewed", 10.0 ** rng.uniform(-200, 200, 2000) * rng.choice([-1, 1], 2000)
    yield "two", rng.choice([1.0, 7.0], 1001)
    yield "half", np.repeat([1.0, 2.0], 500)
    yield "same", np.full(500, 3.5)
    yield "heavy", np.concatenate([np.zeros(4000), rng.normal(size=300)])
    for n in range(1, 12):
        yield f"tiny{n}", rng.normal(size=n)
    yield None, rng.normal(size=50)
    yield "none", np.array([])


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_equal_to_sorting(spark, accuracy):
    q = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    rng = np.random.default_rng(6)
    own = list(groups(rng))
    rows = [(g, 1, float(v)) for g, vs in own for v in vs] + [(g, 1, None) for g, _ in own for _ in range(3)]
    df = spark.createDataFrame(rows, "name string, level int, value double").repartition(5)
    got = {(r["name"], r["q"]): r["quantile"] for r in exact_quantiles(df, ["name", "level"], q=q, accuracy=accuracy).collect()}
    assert len(got) == len(own) * len(q)
    for g, vs in own:
        for x in q:
            assert got[g, x] == (pytest.approx(float(np.quantile(vs, x)), rel=1e-12) if len(vs) else None), (g, x)


def test_few_values_reach_the_last_shuffle(spark):
    """A large group's last step gets the distinct values of a narrow range only."""
    df = spark.range(200_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 200_003).cast("double").alias("value"))
    out = exact_quantiles(df, ["g"], accuracy=1000)
    assert out.collect()[0]["quantile"] == np.median(np.arange(200_000) * 7919 % 200_003)


def test_wrong_arguments(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, value double")
    for groups, q in (([], (0.5,)), (["g"], (1.5,))):
        with pytest.raises(ValueError):
            exact_quantiles(df, groups, q=q)
