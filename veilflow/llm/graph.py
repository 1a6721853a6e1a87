"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_table


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Link the neighbours of each node on one side of it to the smallest of its neighbourhood.

    The minimum is a partial aggregate and comes back by a join that Spark may split, so the centre of
    a large star doesn't fill one task."""
    least = pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    joined = pairs.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
    if larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    own = least.where("m < u").select("u", F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(own).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(u, v) links of any direction -> (u, v): each node but its component's smallest, with that smallest.

    Nodes without links do not appear. Each round is written to the shared folder, so lineage stays short
    and lost executors cost one round at most."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = _state(edges)
    for _ in range(rounds):
        if not last[0]:
            return edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_star(both, True))
        small = cut(_star(large, False))  # large holds (node, smaller node) only
        drop_table(large)
        drop_table(edges)
        edges, now = small, _state(small)
        if now == last:
            return edges
        last = now
    raise RuntimeError("components did not settle")
