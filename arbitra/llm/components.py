"""Connected components of a graph given by its edges, by alternating stars.

Each round hangs every node's larger neighbours, then its smaller ones, under the least node that
it sees (Kiveris et al. 2014).  Rounds are joins and minimum aggregates over the edges, which are
written to the shared folder, so no component has to fit anywhere and lost executors cost one
round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbitra.llm.tables import written


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return written(edges.groupBy("u").agg(F.min("v").alias("m"))).select(F.col("u").alias("at"), "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both).select("at", F.least("at", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("at")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("v < u")
    least = _least_neighbour(down)
    hung = down.join(least, F.col("u") == F.col("at")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionAll(least.select(F.col("at").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component: for every node with an edge to another one, the least node it can reach."""
    now = written(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    mark = None
    while True:
        large = written(_large_star(now).where("u > v").distinct())
        now = written(_small_star(large).distinct())
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark or not new[0]:
            break
        mark = new
    # All edges now lead from a node to the least of its component.
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return written(found.unionAll(found.select(F.col("component").alias("node"), "component").distinct()))
