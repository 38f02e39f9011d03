"""Connected components of an undirected graph, by contraction rounds of joins.

In a round every node takes the node with the smallest hash among itself and its neighbours as its
parent, edges are redrawn between parents and made distinct, and loops go. Every node that isn't a
local minimum leaves; minima are spread at random, whatever the ids mean, so the rounds are few even
for long paths. The parents of all rounds are then composed from the last to the first. Each round is
written to the shared folder, so lineage stays short and a lost executor costs a task, not the run.
Nothing but a row count reaches the driver. Small tables are written in few files (see base.gathered).

A hub's edges meet in partial minima before the shuffle; joins on nodes are left to adaptive skew handling.

Defined results: edges are rows (a, b) in any direction; repeated edges count once; edges from a node to
itself and edges with a null end are left out, and so are nodes that have no others; no edges, no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import forget, gathered, settle, size_of


def components(edges: DataFrame, *, size: int | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node that edges(a, b) join to another; nodes of one component share their root.

    size: bytes that the edges have at most, if that is known. The result is a settled table: forget() it when it has been read.
    """
    edges = edges.select("a", "b").where("a <> b").distinct()
    edges = settle(edges if size is None else gathered(edges, size), "edges")
    levels: list[DataFrame] = []
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        size = 2 * size_of(edges)  # each edge both ways; tables of nodes have no more rows
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("m"))
        parent = F.when(F.xxhash64("m") < F.xxhash64("a"), F.col("m")).otherwise(F.col("a"))
        parents = settle(gathered(first.select(F.col("a").alias("node"), parent.alias("p")), size), "parents")
        levels.append(parents)
        pa, pb = parents.toDF("a", "pa"), parents.toDF("b", "pb")
        drawn = edges.join(pa, "a").select("b", F.col("pa")).join(pb, "b").where("pa <> pb")
        drawn = settle(gathered(drawn.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), size), "edges")
        forget(edges)
        edges = drawn
    else:
        raise RuntimeError(f"components: edges are left after {max_rounds} rounds")
    if not levels:
        out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        out._settled_path = edges._settled_path
        return out
    forget(edges)
    roots = levels.pop()
    now = roots.toDF("node", "root")
    for parents in reversed(levels):
        up = parents.withColumnRenamed("p", "mid").join(now.toDF("mid", "root"), "mid", "left")
        now = settle(gathered(up.select("node", F.coalesce("root", "mid").alias("root")), size_of(parents)), "roots")
        forget(parents, roots)
        roots = now
    now._settled_path = roots._settled_path
    return now
