"""Connected components of a graph given as edges, by alternating star contractions.

Every round links each node's larger neighbours to the smallest node it sees
(large star), then each node and its smaller neighbours to the smallest of them
(small star). Edges never grow in number, and the rounds needed grow with the
logarithm of the longest path. Minima are aggregated before the join, so a node
with very many edges reaches the aggregating task as one row per map task, and
the join has a plain exchange on both sides, which adaptive execution can split.
The edges and each round are checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import checkpointed


def _star(edges: DataFrame) -> DataFrame:
    """edges: (u, v), every edge as the star step wants it seen from u. Gives (v, smallest seen from u)."""
    least = checkpointed(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")))
    return edges.join(least, edges.u == least.w).select("u", "v", "m")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Edges with a null end are ignored; self loops and repeated edges change nothing
    but that a node with only a self loop is its own component.
    """
    pairs = checkpointed(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL"))
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    now = pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = checkpointed(now)
    before = None
    for _ in range(rounds):
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = checkpointed(large)
        found = _star(large)
        small = found.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = checkpointed(small.select("e.u", "e.v").where("u <> v").distinct())
        # Settled once every larger node has one edge and no node is on both sides.
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if before == tuple(state):
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    label = now.select(F.col("u").alias("l"), F.col("v").alias("component"))
    return (
        nodes.distinct().join(label, F.col("node") == F.col("l"), "left").select("node", F.coalesce("component", "node").alias("component"))
    )
