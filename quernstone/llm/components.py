"""Connected components of a graph given by its edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import cut

#: Up to so many edges one task joins them; more are joined by rounds of shuffles. Both give the same result.
ONE_TASK = 1_000_000


def _union(batches):
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            parent.setdefault(x, x)
            parent.setdefault(y, y)
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of every node of edges (a long, b long): component is the smallest node reachable."""
    edges = cut(edges.select("a", "b").distinct())
    if edges.count() <= one_task:
        return edges.coalesce(1).mapInArrow(_union, "node long, component long")
    both = cut(edges.union(edges.select("b", "a")).toDF("a", "b").distinct())
    label = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).toDF("node", "l"))
    while True:
        near = both.join(label.toDF("b", "l"), "b").groupBy("a").agg(F.min("l").alias("m")).withColumnRenamed("a", "node")
        lower = cut(label.join(near, "node").select("node", F.least("l", "m").alias("n"), F.col("l").alias("was")))
        # every label is itself a node: take its label instead of it
        jump = lower.join(lower.select(F.col("node").alias("n"), F.col("n").alias("top")), "n").select("node", F.least("n", "top").alias("l"), "was")
        jump = cut(jump)
        changed = jump.where("l <> was").limit(1).count()
        label = jump.select("node", "l")
        if not changed:
            return label.toDF("node", "component")
