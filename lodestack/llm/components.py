"""Connected components of a graph given as a table of links, by alternating large and small stars.

Each step joins every node to the smallest node of its neighbourhood and keeps components as they are; the number of
steps grows with the logarithm of the longest chain. Nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.store import written


#: A node of more links than this, and than one in HUBS of all, is a hub. There are fewer than HUBS of them, so that they are broadcast.
DEGREE, HUBS = 32, 500_000


def _met(links: DataFrame, side: str, least: DataFrame, n_links: int, how: str) -> DataFrame:
    """links joined with least (node, m) by their column side; the links of hubs, which would all come to one task, by broadcast."""
    hubs = written(links.groupBy(F.col(side).alias("hub")).agg(F.count("*").alias("n")).where(F.col("n") > max(DEGREE, n_links // HUBS)).select("hub"), "components-hubs")
    if hubs.isEmpty():
        return links.join(least, links[side] == least["node"], how).drop("node")
    own = hubs.join(least, hubs["hub"] == least["node"], how).select("hub", "m")
    many = links.join(F.broadcast(own), links[side] == own["hub"]).drop("hub")
    few = links.join(F.broadcast(hubs), links[side] == hubs["hub"], "left_anti")
    return many.unionByName(few.join(least, few[side] == least["node"], how).drop("node"))


def _minima(links: DataFrame) -> DataFrame:
    """(node, m): the smallest neighbour of every node that has a smaller one. a is the larger node of a link."""
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))


def _large_star(links: DataFrame, n_links: int) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    return _met(links, "b", _minima(links), n_links, "left").select("a", F.coalesce("m", "b").alias("b"))


def _small_star(links: DataFrame, n_links: int) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = _minima(links)
    moved = _met(links, "a", least, n_links, "inner").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), of any type with an order; root is the smallest node of its component, listed too.

    Nulls and links of a node to itself count for nothing.
    """
    now = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, "components-links")
    sign = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    seen = now.agg(sign).first()[0]
    while seen[0]:
        now = written(_large_star(now, seen[0]).where("a <> b").distinct(), "components-links")
        now = written(_small_star(now, seen[0]).where("a <> b").distinct(), "components-links")
        last, seen = seen, now.agg(sign).first()[0]
        if seen == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
