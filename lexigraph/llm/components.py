"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is two shuffles on nodes; the edges are written to the shared folder every round, so a
lost executor costs one round at most. Nodes keep only their smallest neighbour, so a hub's
neighbours are never gathered: its row is joined back to its edges, which AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, unsent


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component), one for each node of `edges` (a long, b long); component is the smallest node reachable.

    Self-loops, repeated edges and either direction are fine; null ends are dropped. Empty in, empty out.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = materialize(links, "edges")
    seen = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(unsent(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: a node's smaller neighbours, and itself, hang on the smallest of them.
        small = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        floor = small.groupBy("a").agg(F.min("b").alias("m"))
        hung = small.join(unsent(floor), "a")
        new = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(floor.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(new, "edges")
        sign = new.agg(F.count("*"), F.sum(F.xxhash64("b", "a").bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_xor(F.xxhash64("a", "b"))).first()
        discard(links)
        links = new
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.distinct())
