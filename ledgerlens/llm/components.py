"""Connected components by alternating large-star and small-star rounds.

Each round is two combined group-bys with joins on node ids; edges are contracted to a forest inside every partition first.
Every round is written to the shared folder, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (node, smallest node) of a partition; memory follows the nodes of the partition."""
    parent: dict[int, int] = {}

    def root(x):
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = [x for x in parent if parent[x] != x]
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pa.record_batch([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the smallest node reachable) for every node with an edge to another node.

    `edges` has two long columns; loops and repeated edges do no harm; null ends are ignored; no edges give no rows.
    """
    a, b = edges.columns
    plain = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    current = cut_lineage(plain.mapInArrow(_forest, "a long, b long").distinct(), name)
    state = _state(current)
    while state[0]:
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct(F.col("a"), F.col("low").alias("b")))).alias("e"))
        nxt = cut_lineage(small.select("e.a", "e.b").where("a <> b").distinct(), name)
        before, state, current = state, _state(nxt), nxt
        if state == before:
            break
    roots = current.select("b").distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select(F.col("b").alias("node"), F.col("b").alias("component")))
