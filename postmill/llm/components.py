"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.shared import written


def _least(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of every node, itself included; pre-aggregated before the shuffle."""
    return edges.groupBy("u").agg(F.least("u", F.min("v")).alias("least"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every node of ``(u, v)`` edges; a component is named by its smallest node.

    Each round hangs neighbours below the smallest node they know of. The number of rounds grows with the
    logarithm of the number of nodes; edges go through a table each round, so no lineage builds up.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = _both(edges)
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        small = large.where("u <> v").distinct()
        hung = small.join(_least(small), "u")
        below = hung.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        own = hung.select("u", F.col("least").alias("v"))
        edges = written(below.unionByName(own).where("u <> v").distinct(), "edges")
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    tops = edges.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops).groupBy("id").agg(
        F.min("component").alias("component")
    )
