"""Distances of dyads: equal to plain Python, and only frames of two people are aggregated."""

import random

from kinelattice.operators import dyads


def test_body_distance_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(60)]), rng.choice(["a", "b", "c", "d", None][: rng.choice([2, 3, 5])]), rng.choice([None, *map(float, range(30))]), float(rng.randint(0, 9))) for _ in range(300)]
    df = spark.createDataFrame(rows, "frame int, person string, x double, y double")
    want = []
    for f in range(60):
        own = {p: [r[2:] for r in rows if r[0] == f and r[1] == p] for p in {r[1] for r in rows if r[0] == f}}
        if len(own) == 2 and None not in own:
            mean = {p: [None if None in c else sum(c) / len(c) for c in zip(*v)] for p, v in own.items()}
            a, b = mean.values()
            d = None if None in (*a, *b) else round(sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5, 9)
            want += [(f, p, d) for p in own]
    got = [(r["frame"], r["person"], None if r["distance"] is None else round(r["distance"], 9)) for r in dyads.body_distance(df, ["frame"], ["x", "y"]).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(d for *_, d in want) and any(d is None for *_, d in want)


def test_body_distance_aggregates_dyads_only(spark):
    """Hash maps hold one row for a frame of two people, none for the others, and no lists of people."""
    df = spark.createDataFrame([(f, p, float(f + p), 1.0) for f in range(20) for p in range(1 + f % 5)], "frame int, person int, x double, y double")
    out = dyads.body_distance(df, ["frame"], ["x", "y"])
    assert out.count() == 8
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("Aggregate [") == 1
    grouped = plan[plan.index("Aggregate [") :]
    assert grouped.index("Filter") < grouped.index("Window")
