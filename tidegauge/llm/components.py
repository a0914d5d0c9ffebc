"""Connected components over a distributed table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node gives its larger neighbours the smallest of itself and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node gives itself and its smaller neighbours the smallest of them. Edges come as u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node that has a link; ``links`` has two long columns.

    Each round is staged, so no round is computed twice. Rounds grow with the logarithm of the longest path; a star (what
    near-duplicate search mostly gives) takes one. Nothing is collected but one row of figures for each round.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    now = stage(edges, "links")
    figures = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    state = figures(now)
    if state[0]:
        for _ in range(most):
            after = stage(_small_star(_large_star(now)).where("u != v").distinct(), "links")
            unstage(now)
            now, before, state = after, state, figures(after)
            if before == state:
                break
        else:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
