"""Connected components of an edge table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Up to so many edges one task merges them in memory; beyond, alternating stars run over the cluster.
ONE_TASK_EDGES = 4_000_000


def _merge(table):
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist()):
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if parent[x] != x]
    return pa.table({"node": pa.array(nodes, pa.int64()), "label": pa.array([root(x) for x in nodes], pa.int64())})


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, label) of every node of the edges (a, b) but the least of each component, which is the label.

    Loops and repeated edges change nothing, edges with a null are left out, no edges give no rows.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.count() <= one_task:
        return cut(edges.groupBy().applyInArrow(_merge, "node long, label long"))
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = cut(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        seen = now
