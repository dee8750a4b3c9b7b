"""Connected components by alternating large-star and small-star steps over written edge tables.

Smallest node ids win.  Each step moves links towards smaller neighbours; a step's minima are aggregated before
they are shuffled and joined back as written tables, so that a node of very high degree can be split.
Nothing but a count and a checksum of the links reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, small


def connected(edges: DataFrame, ws: Workspace, name: str, rounds: int = 64) -> DataFrame:
    """edges (a, b), both long, any order -> written (node, root) of every node with a link, root the smallest id."""
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = ws.put(links, f"{name}-0")
    before = None
    for k in range(1, rounds + 1):
        state = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = small(ws.put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-{k}-m"), 16)
        large = ws.put(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-{k}-l")
        least = small(ws.put(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{k}-n"), 16)
        near = large.join(least, "u")
        star = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        links = ws.put(star.distinct(), f"{name}-{k}")
        for old in (f"{name}-{k - 1}", f"{name}-{k}-m", f"{name}-{k}-l", f"{name}-{k}-n"):
            ws.drop(old)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # At the end every link leads straight to its root.
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v"), F.col("v"))).distinct()
