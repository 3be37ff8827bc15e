"""Connected components by alternating large-star and small-star steps.

Every step is a partial-aggregated minimum per node and a join back to the
edges; no neighbourhood is ever gathered in one task, so a hub with a third of
all edges is split by AQE like any other skewed join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.tables import dealt_anew, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected `edges` (a, b); component = smallest node reached.

    Null ends and self-links are dropped, repeated links count once, and no
    links give an empty result. Nodes that have no link are not in the result.
    """
    links = (
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    links, before = stored(links), None
    while True:
        links = stored(_small_star(_large_star(links)))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # at the fixed point every edge joins a node to the smallest node of its component
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)


def _large_star(links: DataFrame) -> DataFrame:
    """Joins each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = links.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(
        links.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
    )
    least = both.groupBy("node").agg(F.least("node", F.min("other")).alias("least"))
    return (
        both.join(dealt_anew(least, "node"), "node")
        .filter("other > node")
        .select(F.col("other").alias("hi"), F.col("least").alias("lo"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("hi").agg(F.min("lo").alias("least"))
    moved = links.join(dealt_anew(least, "hi"), "hi").select(F.col("lo").alias("node"), "least")
    return (
        moved.union(least.select(F.col("hi").alias("node"), "least"))
        .filter("node <> least")
        .select(F.col("node").alias("hi"), F.col("least").alias("lo"))
        .distinct()
    )
