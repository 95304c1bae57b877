"""Connected components by contraction: every vertex points to its smallest neighbour, edges move to the targets, repeat.

Vertices are fingerprints, so their order is random along any path and a round drops a constant part of them (a path of
sorted ids would take a round for each vertex). Neighbour minima pre-aggregate, so a hub is no hot task. Nothing is
collected; the driver only asks whether edges remain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.llm._spark import cut


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the undirected edges (a, b); root: one vertex of its component."""
    edges = cut(edges.where("a <> b").select("a", "b").distinct())
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        to = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("root")))
        maps.append(to)
        moved = edges.join(to.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a")
        moved = moved.join(to.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b")
        edges = cut(moved.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = maps[-1]
    for to in reversed(maps[:-1]):
        up = out.select(F.col("v").alias("root"), F.col("root").alias("top"))
        out = to.join(up, "root", "left").select("v", F.coalesce("top", "root").alias("root"))
    return cut(out)
