"""Connected components of an undirected graph, without collecting edges, hubs or components anywhere.

Alternates two star contractions (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). Each is an
aggregate and a join on the node, so that a hub's edges combine before the shuffle and a skewed join can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberglass.storage import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of these; edges point from the larger (u) to the smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """Rows (node, component) for every node of an edge; component is its least reachable node.

    Nodes may be of any orderable type. Edges with a null end link nothing; loops give their node as a component of its
    own; repeated edges and either direction are the same. Every round is written to the shared folder, the last but
    one is deleted.
    """
    a, b = F.col(src), F.col(dst)
    nodes = scratch.save(edges.filter(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    now = scratch.save(nodes.filter("u <> v"), "stars")
    seen = None
    for _ in range(max_rounds):
        large = scratch.save(_large_star(now), "large")
        new = scratch.save(_small_star(large), "stars")
        sign = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        scratch.drop(large)
        now = new
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(found.select("node"), "node", "left_anti")
    return found.union(roots.select("node", F.col("node").alias("component")))
