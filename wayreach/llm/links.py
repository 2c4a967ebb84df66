"""Connected components of links, as rounds of joins on narrow rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayreach.functions.scratch import Scratch


def _to_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least of u's neighbours and of u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, group) of all ids in ``links`` (a, b); the group is its least id.

    Alternating stars: each node's greater neighbours are linked to the least node it
    knows, then each node and its smaller neighbours are. The edges end as one star for
    each component, after about log(n) rounds.
    """
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("group")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("group")).distinct()
            )
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _to_least(large)
        small = near.select("u", F.col("m").alias("v")).unionByName(near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = scratch.replace(edges, small.distinct(), "edges")
