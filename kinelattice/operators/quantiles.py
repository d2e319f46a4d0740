"""Exact quantiles of groups of any size, without holding a group's values.

1. A sketch of bounded size per group (``percentile_approx``) gives a low and a high value whose ranks are certain to enclose
   the wanted one. 2. One pass counts, for all groups at once, what lies below and inside its range; a group whose range
   misses the rank (only tiny ones can) takes all its values. 3. The distinct values inside the ranges, a few in
   ``accuracy`` of a large group, are counted and their running counts give the values at the wanted ranks.

Memory is bounded by the range table and the sketches; repeated values collapse before the last shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(groups: list[str]) -> Column:
    return reduce(lambda p, q: p & q, (F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(groups)))


def exact_quantiles(df: DataFrame, groups: list[str], value: str = "value", q: tuple[float, ...] = (0.5,), accuracy: int = 10_000) -> DataFrame:
    """groups, q, quantile: linear between neighbours, missing values left out; NULL for a group without a value."""
    if not groups or any(not 0 <= x <= 1 for x in q):
        raise ValueError("exact_quantiles needs groups, and quantiles from 0 to 1")
    rows = df.select(*groups, F.col(value).cast("double").alias("_v"))
    slack = 2.0 / accuracy
    at = [F.array(F.lit(max(x - slack, 0.0)), F.lit(min(x + slack, 1.0))) for x in q]
    own = F.array(*(F.struct(F.lit(float(x)).alias("q"), F.percentile_approx("_v", a, accuracy).alias("range")) for x, a in zip(q, at)))
    ranges = rows.groupBy(*groups).agg(F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), own.alias("_own"))
    ranges = ranges.select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)), "_n", "_min", "_max", F.explode("_own").alias("_o"))
    ranges = ranges.select("*", F.col("_o.q").alias("_q"), F.get("_o.range", F.lit(0)).alias("_low"), F.get("_o.range", F.lit(1)).alias("_high"), ((F.col("_n") - 1) * F.col("_o.q")).alias("_h")).drop("_o")
    keys = [f"_g{k}" for k in range(len(groups))]
    met = rows.join(ranges, _same(groups)).select(*keys, "_q", "_n", "_min", "_max", "_low", "_high", "_h", "_v")
    counts = met.groupBy(*keys, "_q", "_n", "_min", "_max", "_low", "_high", "_h").agg(F.count_if(F.col("_v") < F.col("_low")).alias("_below"), F.count_if((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))).alias("_in"))
    holds = (F.col("_below") <= F.floor("_h")) & (F.col("_below") + F.col("_in") > F.ceil("_h"))
    either = lambda a, b, name: F.when(holds, F.col(a)).otherwise(b).alias(name)
    narrowed = counts.select(*keys, "_q", "_h", either("_below", F.lit(0), "_skip"), either("_low", F.col("_min"), "_from"), either("_high", F.col("_max"), "_to"))
    inside = rows.join(narrowed, _same(groups) & (F.col("_v") >= F.col("_from")) & (F.col("_v") <= F.col("_to")))
    distinct = inside.groupBy(*keys, "_q", "_h", "_skip", "_v").agg(F.count(F.lit(1)).alias("_c"))
    up = Window.partitionBy(*keys, "_q").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = distinct.withColumn("_end", F.col("_skip") + F.sum("_c").over(up))  # ranks from _end - _c to _end - 1, from 0
    has = lambda rank: (F.col("_end") > rank) & (F.col("_end") - F.col("_c") <= rank)
    low, high = (F.max(F.when(has(f("_h")), F.col("_v"))) for f in (F.floor, F.ceil))
    picked = ranked.groupBy(*keys, "_q", "_h").agg(low.alias("_a"), high.alias("_b"))
    found = picked.select(*keys, F.col("_q").alias("_fq"), (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.floor("_h"))).alias("quantile"))
    every = rows.select(*groups).distinct().select(*groups, F.explode(F.array(*(F.lit(float(x)) for x in q))).alias("q"))
    return every.join(found, _same(groups) & (F.col("q") == F.col("_fq")), "left").select(*groups, "q", "quantile")
