"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node that can be reached.

    Each round hangs every node on its smallest neighbour, shortens the paths, and contracts the edges; only edges
    between different roots go on, so the rounds are few. No round gathers a node's neighbours.
    """
    edges = cut(_tidy(edges))
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up"))
        for _ in range(2):
            step = up.select(F.col("a").alias("k_"), F.col("up").alias("next_"))
            up = up.join(step, up.up == step.k_, "left").select("a", F.coalesce("next_", "up").alias("up"))
        up = cut(up)
        if found is None:
            found = up.select(F.col("a").alias("node"), F.col("up").alias("component"))
        else:
            step = up.select(F.col("a").alias("k_"), F.col("up").alias("next_"))
            new = step.join(found.select("node"), step.k_ == F.col("node"), "left_anti").select(F.col("k_").alias("node"), F.col("next_").alias("component"))
            found = found.join(step, found.component == step.k_, "left").select("node", F.coalesce("next_", "component").alias("component")).unionByName(new)
            found = cut(found)
        for side in ("a", "b"):
            step = up.select(F.col("a").alias("k_"), F.col("up").alias("next_"))
            edges = edges.join(step, edges[side] == step.k_).withColumn(side, F.col("next_")).drop("k_", "next_")
        edges = cut(_tidy(edges))
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
