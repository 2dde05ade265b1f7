"""Connected components of a graph given as pairs, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on nodes, so a node with a third of all links is no
bottleneck: minima combine before the shuffle and adaptive execution splits the join. The number of
rounds grows with the logarithm of the longest path. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has columns u and v, u != v; returns node and component (its least node).

    Nodes without links are not in the result. ``settle`` or ``drop_cut`` deletes what it is made of.
    """
    here = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = here.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == seen:
            break
        seen = (state.n, state.h)
        then = cut(_small_star(_large_star(here)))
        drop_cut(here)
        here = then
    links = here.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = links.union(here.select(F.col("v"), F.col("v")).distinct())
    out._veldt_path = here._veldt_path
    return out
