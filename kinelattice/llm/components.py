"""Connected components: union-find inside tasks, then alternating large and small stars.

Edges are dealt to as many tasks as their number asks for; each joins its own edges by union-find and hands on one
edge per node. Between tasks, each round rewires every edge to the least neighbour on one side, so paths shrink
geometrically. Only minima are taken per node (aggregated before the shuffle), and neighbour lists are never gathered,
so a hub of any degree is no problem. Rounds are cut with written tables in the shared folder. Nodes are numbers or
16-byte digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelattice.session import cut, drop, importable

#: Edges that one task joins by union-find.
EDGES_PER_TASK = 250_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) with b the least node that a's edges in this task reach."""
    root: dict = {}
    kind = pa.int64()

    def find(x):
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        kind = batch.column("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["a", "b"])


def _print(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b: bigint or binary) that are not the least of their component."""
    importable(edges.sparkSession)
    given = edges if hasattr(edges, "_kl_path") else cut(edges.select("a", "b"), "edges")
    kind = dict(given.dtypes)["a"]
    tasks = -(-given.count() // EDGES_PER_TASK) or 1
    now = cut(given.select("a", "b").filter("a <> b").repartition(tasks).mapInArrow(_union_find, f"a {kind}, b {kind}"), "edges")
    if given is not edges:
        drop(given)
    mark = _print(now) if tasks > 1 else None
    while mark and mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))
        after = cut(small.distinct(), "edges")
        drop(now)
        now, last, mark = after, mark, _print(after)
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
