"""Connected components of an edge list, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (u, v, m) with m the least of u and its neighbours. Min is combined before the shuffle,
    and the join back has one row a node on one side, so a node with very many edges can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("k")).drop("k")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _min_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = _min_neighbour(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    moved = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(down.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) long, u <> v, any direction. Returns (u, component): every node of an edge but each component's least one,
    with that least one. Alternates large and small stars until nothing changes: rounds grow with the log of the component's size squared at most."""
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select("u", F.col("v").alias("component"))
        state = now
        edges = cut(_small_star(_large_star(edges)))
