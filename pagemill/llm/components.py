"""Connected components by alternating large and small stars; edges stay distributed."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.work import removed, written

ONE_TASK = 1 << 19  # edges that a single task joins in memory; more are joined by rounds


def _summary(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _rooted(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", "v").distinct())


def _forest(batches):
    """A task's edges without those that close a circle; every node points to the smallest of its tree."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            p, q = top(u), top(v)
            if p != q:
                up[max(p, q)] = min(p, q)
    rows = [(x, top(x)) for x in up]
    for i in range(0, len(rows), 1 << 16):
        part = rows[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([y for _, y in part], pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the long columns a and b; root is the component's smallest node.

    Up to ONE_TASK edges are joined by one task. Beyond, rounds grow with the logarithm of a component's longest path. A hub's edges are
    pre-aggregated to its minimum and met by a join that Spark can split.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = written(e, "edges")
    was = _summary(e)
    if was[0] <= ONE_TASK:
        new = written(e.coalesce(1).mapInArrow(_forest, "u long, v long"), "edges")
        removed(e)
        return _rooted(new)
    while was[0]:
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, "edges")
        removed(e)
        e, now = new, _summary(new)
        if now == was:
            break
        was = now
    return _rooted(e)
