"""Connected components of a graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultweave.llm.shared import saved


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b): the smallest node it reaches.

    Large-star and small-star steps by turns: each hangs the neighbours of a node on their
    smallest, which keeps reach as it is and needs rounds by the logarithm of a path's length.
    A round is two joins of narrow rows and is written to the shared folder, so a lost executor
    repeats no earlier round. Pairs with a null end or with equal ends say nothing and go.
    """
    edges = saved(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = _fingerprint(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"))
        edges = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = edges.where("u <> v").distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        hung = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(hung.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def _fingerprint(edges: DataFrame) -> tuple:
    """One row that tells whether a round changed an edge."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
