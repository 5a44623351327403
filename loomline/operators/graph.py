"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.skew import hot_aware_lookup
from loomline.plans.lineage import materialize, release


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for each node of an edge the smallest node it is connected with.

    Alternates large-star and small-star steps: every step replaces each node's edges by edges
    to its smallest neighbour and needs O(log n) rounds. Minima are aggregated before the
    shuffle and looked up with salted hot nodes, so a node with many edges is no bottleneck. Each
    round is a table in the shared folder. Loops and repeated edges are harmless; edges with a
    null end are dropped; no edge gives no row.
    """
    links = materialize(
        edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    before = None
    while True:
        before_links, links = links, materialize(_small_star(_large_star(links)))
        release(before_links)
        now = tuple(links.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first())
        if now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's smallest neighbour (or the node)."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("n"))
    return hot_aware_lookup(both, least, "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and all its smaller neighbours are linked with the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    found = hot_aware_lookup(links, least, "u", "n")
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
