"""Connected components of a large graph by Spark joins: alternating large-star and small-star rounds.

Every edge points from the larger node to the smaller one. A large-star round hangs the larger neighbours of a node
on the least node that it knows; a small-star round does so for the smaller neighbours. The edges become stars around
the least node of each component after about log(n) rounds. Minima are aggregated before they are shuffled and no
round gathers a node's neighbours; edges meet minima in joins of two plain shuffles, so that Spark can split a hub with
very many edges over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _meet(edges: DataFrame, end: str, least: DataFrame) -> DataFrame:
    """Edges with the minimum m of their node at one end. Dealing the minima out first keeps the join's shuffle apart from
    that of their aggregation."""
    return edges.join(least.repartition("n", "m"), F.col(end) == F.col("n"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("n")).agg(F.least(F.col("n"), F.min("v")).alias("m"))
    return _meet(edges, "v", least).select("u", F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    moved = _meet(edges, "u", least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select(F.col("n").alias("u"), F.col("m").alias("v")))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of ``links``, whose first two columns are the ends of an edge.

    root is the least node of the component. Loops and edges with a null end link nothing and give no row; repeated
    edges count once. Without any edge the result is empty.
    """
    a, b = links.columns[:2]
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = durable(ends.where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        edges = durable(_small_star(_large_star(edges).distinct()).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
