"""Connected components by alternating stars, each round a written table."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnspark.llm.common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str = "component") -> DataFrame:
    """(node, component) for every node of links (a, b), component being the least node it reaches.

    Large-star links each node's greater neighbours to its least one, small-star the lesser ones;
    repeated, however many rounds that takes, every component is a star, which one aggregate tells. The least
    neighbour is a partial aggregate, so a hub is no group to gather; joins back to it can be split by Spark where skewed.
    Loops and repeated links do no harm; no links give no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    for k in itertools.count():
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = scratch.keep(small.where("u <> v").distinct(), f"{name}-{k}")
        if k:
            scratch.drop(f"{name}-{k - 1}")
        if _are_stars(edges):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of edges (u, v), u > v, has either greater neighbours alone or a single one, which is less."""
    ends = edges.select("u", F.col("v").alias("less"), F.lit(0).alias("up")).union(edges.select(F.col("v").alias("u"), F.lit(None).cast("long"), F.lit(1)))
    nodes = ends.groupBy("u").agg(F.min("less").alias("lo"), F.max("less").alias("hi"), F.max("up").alias("up"))
    return not nodes.where("lo < hi OR (lo IS NOT NULL AND up = 1)").agg(F.count(F.lit(1))).first()[0]


def stars(links: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that join what the given ones join, each from a node to the least one it reaches."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return [(x, top(x)) for x in list(above) if top(x) != x]
