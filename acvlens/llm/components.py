"""Connected components of a link table, as joins and aggregates.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): every step only needs the smallest
neighbour of a node, which is a map-side combined ``min``; a hub's links are
spread over a join that AQE can split.  The number of rounds grows
with the logarithm of the links.  Each round is written to the shared folder.
Every node has a smallest neighbour, but the joins are outer ones (and no
filter is null-rejecting): then only the nodes' table can be broadcast, whose
rows Spark has counted in its aggregate, never the links, which it would
take to be as small as their packed Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of all nodes with a link; component is its smallest node."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    edges = stash(edges)
    state = _state(edges)
    while state[0]:
        edges = stash(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == state:
            break
        state = now
    tree = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tree.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.join(least, "u", "left").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    pairs = edges.join(least, "u", "left")
    return (pairs.where("NOT v <=> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct())
