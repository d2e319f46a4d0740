"""Golden comparison of two roots of archives: structure from headers, values only where they may differ.

Files are matched by their path under the root, arrays by name. Headers tell of missing files and arrays, shapes, types
and axis names. Where type, length and checksum of an array agree on both sides it counts as equal and is not read, unless
``verify`` asks for it; all others are read on both sides, part by part in tasks, and only sums leave them.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelattice.session import cut, importable
from kinelattice.sources.npz import Member, read_array, read_axes

_AXES = [f"axis{k}" for k in range(5)]
_PART = 8 << 20
_SUMS = "file string, array_name string, n bigint, different bigint, greatest double, total double, mean double, m2 double"


def _side(spark: SparkSession, root: str, ignore: tuple[str, ...]) -> DataFrame:
    rows = read_axes(spark, root).withColumn("file", F.substring("path", len(root) + 2, 1 << 20))
    for part in ignore:
        rows = rows.filter(~F.col("file").contains(part))
    return rows.select("file", "array_name", "shape", F.array(*_AXES).alias("axes"), "kind", "bytes", "crc", "problem")


def value_sums(pairs: DataFrame, ours: str, golden: str, rtol: float, atol: float) -> DataFrame:
    """Sums of the differences of arrays of one shape, (file, array_name) with their number of values ``n``; a row per part."""
    importable(pairs.sparkSession)

    def sums(file: str, name: str, start: int, stop: int) -> tuple:
        with zipfile.ZipFile(os.path.join(ours, file)) as x, zipfile.ZipFile(os.path.join(golden, file)) as y:
            a, b = Member(x, name), Member(y, name)
            if a.fortran or b.fortran:  # other orders of the same values: the first part takes all
                whole = start == 0
                p, q = (read_array(os.path.join(root, file), name).ravel() if whole else np.zeros(0) for root in (ours, golden))
            else:
                p, q = a.values(start, stop), b.values(start, stop)
        if not (np.issubdtype(p.dtype, np.floating) and np.issubdtype(q.dtype, np.floating)):
            return (file, name, 0, int((p != q).sum()), None, None, None, None)
        p, q = p.astype(float), q.astype(float)
        d = p - q
        known = ~np.isnan(d)
        apart = ~(np.isclose(p, q, rtol=rtol, atol=atol, equal_nan=True))
        n, own = int(known.sum()), d[known]
        mean = float(own.mean()) if n else 0.0
        return (file, name, n, int(apart.sum()), float(np.abs(own).max()) if n else None, float(np.abs(own).sum()), mean, float(((own - mean) ** 2).sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(x.split(" ") for x in _SUMS.split(", ")))
        types = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
        for batch in batches:
            rows = [sums(*r.values()) for r in batch.select(["file", "array_name", "start", "stop"]).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows), kinds)], list(names))

    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(_PART).cast("bigint"))
    parts = pairs.select("file", "array_name", "n", F.explode(starts).alias("start")).withColumn("stop", F.least(F.col("start") + _PART, F.col("n")))
    return parts.repartition("file", "array_name", "start").mapInArrow(run, _SUMS)


def compare_roots(spark: SparkSession, ours: str, golden: str, rtol: float = 1e-5, atol: float = 1e-8, ignore: tuple[str, ...] = (), verify: bool = False) -> DataFrame:
    """One row per difference: file, array_name, problem, ours, golden, different, max_abs, mean_abs, std_diff.

    Problems: missing file, extra file, missing array, extra array, unreadable, type, shape, axes, values. The last three
    columns are over the values that both sides have (the deviation is the population's); NaN equals NaN. Files whose path
    holds one of ``ignore`` are left out.
    """
    ours, golden = ours.removeprefix("file://").rstrip("/"), golden.removeprefix("file://").rstrip("/")
    a, b = (cut(_side(spark, root, ignore), "compare-axes") for root in (ours, golden))
    files = a.select("file").distinct().withColumn("in_a", F.lit(1)).join(b.select("file").distinct().withColumn("in_b", F.lit(1)), "file", "full_outer")
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    lone = files.filter("in_a is null or in_b is null").select("file", none.alias("array_name"), F.when(F.col("in_a").isNull(), "missing file").otherwise("extra file").alias("problem"), none.alias("ours"), none.alias("golden"))
    side = lambda df, s: df.filter("array_name is not null").select("file", "array_name", *(F.col(c).alias(f"{c}_{s}") for c in ("shape", "axes", "kind", "bytes", "crc")))
    both = side(a, "a").join(side(b, "b"), ["file", "array_name"], "full_outer").join(files.filter("in_a = 1 and in_b = 1").select("file"), "file", "left_semi")
    bad = F.array(
        F.when(F.col("kind_a").isNull(), F.struct(F.lit("missing array").alias("problem"), none.alias("ours"), none.alias("golden"))),
        F.when(F.col("kind_b").isNull(), F.struct(F.lit("extra array").alias("problem"), none.alias("ours"), none.alias("golden"))),
        *(F.when(~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) & F.col("kind_a").isNotNull() & F.col("kind_b").isNotNull(), F.struct(F.lit(p).alias("problem"), text(f"{c}_a").alias("ours"), text(f"{c}_b").alias("golden"))) for c, p in (("kind", "type"), ("shape", "shape"), ("axes", "axes"))),
    )
    structure = both.select("file", "array_name", F.inline(F.array_compact(bad)))
    broken = [df.filter("problem = 'no readable description'").select("file", none.alias("array_name"), F.lit("unreadable").alias("problem"), (text("problem") if s == "a" else none).alias("ours"), (text("problem") if s == "b" else none).alias("golden")) for df, s in ((a, "a"), (b, "b"))]
    same = (F.col("kind_a") == F.col("kind_b")) & (F.col("bytes_a") == F.col("bytes_b")) & (F.col("crc_a") == F.col("crc_b"))
    pairs = both.filter("shape_a = shape_b").filter(F.lit(verify) | ~same).select("file", "array_name", F.aggregate("shape_a", F.lit(1).cast("bigint"), lambda p, x: p * x).alias("n"))
    parts = value_sums(pairs.filter("n > 0"), ours, golden, rtol, atol)
    n = F.sum("n")
    mean = F.try_divide(F.sum(F.col("mean") * F.col("n")), n)
    spread = F.sqrt(F.greatest(F.try_divide(F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")), n) - mean * mean, F.lit(0.0)))
    numbers = parts.groupBy("file", "array_name").agg(F.sum("different").alias("different"), F.max("greatest").alias("max_abs"), F.try_divide(F.sum("total"), n).alias("mean_abs"), spread.alias("std_diff")).filter("different > 0")
    values = numbers.select("file", "array_name", F.lit("values").alias("problem"), none.alias("ours"), none.alias("golden"), "different", "max_abs", "mean_abs", "std_diff")
    flat = [lone, structure, *broken]
    wide = [df.withColumns({"different": F.lit(None).cast("bigint"), **{c: F.lit(None).cast("double") for c in ("max_abs", "mean_abs", "std_diff")}}) for df in flat]
    out = values
    for df in wide:
        out = out.unionByName(df)
    return out
