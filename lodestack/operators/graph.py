"""Bounded traversal and components of a graph kept as an edge table (src, dst, type, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.fixed import EDGE_WEIGHTS, EXPANSIONS
from lodestack.shared import numbered, small, written


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def best_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, type), that with the most confidence; no loops."""
    return edges.where("src <> dst").groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"))


def levels(edges: DataFrame, start: DataFrame, depth: int, least: float = 0.0) -> DataFrame:
    """(node, depth): every node within depth steps of the start nodes (column node), with its smallest distance."""
    step = edges.where(F.col("confidence") >= least).select("src", "dst").distinct()
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        found = front.join(step, front["node"] == step["src"]).select(F.col("dst").alias("node")).distinct()
        front = written(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)), "graph-front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


#: A node of more links than this, and than one in HUBS of all, is a hub; there are fewer than HUBS.
DEGREE, HUBS = 128, 500_000


def _with_least(links: DataFrame, side: str, least: DataFrame, n: int) -> DataFrame:
    """links with m, the smallest neighbour of the node in column side; the many links of a hub meet it by broadcast."""
    hubs = links.groupBy(F.col(side).alias("node")).agg(F.count("*").alias("k")).where(F.col("k") > max(DEGREE, n // HUBS)).select("node")
    own = small(written(hubs.join(least, "node", "left"), "graph-hubs"), HUBS)
    of_hubs = links.join(own, links[side] == own["node"]).drop("node")
    rest = links.join(own, links[side] == own["node"], "left_anti")
    return of_hubs.unionByName(rest.join(least, rest[side] == least["node"], "left").drop("node"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that undirected edges reach, by alternating large and small stars until nothing changes.

    Nodes are numbered in their order first, so that links are pairs of numbers. Every step hooks the neighbours of a node to the smallest of
    them; the number of steps grows with the logarithm of the longest chain.
    """
    pairs = edges.where("src <> dst").select("src", "dst")
    names = written(numbered(pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct(), "node", row="id"), "graph-names")
    side = lambda c: names.select(F.col("id").alias(f"{c}_id"), F.col("node").alias(c))
    links = pairs.join(side("src"), "src").join(side("dst"), "dst").select(F.greatest("src_id", "dst_id").alias("a"), F.least("src_id", "dst_id").alias("b")).distinct()
    links = written(links, "graph-links")  # a is the larger end
    sign = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    seen = links.agg(*sign).first()
    while seen[0]:
        least = lambda: links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        links = written(_with_least(links, "b", least(), seen[0]).select("a", F.coalesce("m", "b").alias("b")).distinct(), "graph-links")
        small_star = _with_least(links, "a", least(), seen[0])
        links = written(small_star.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_star.select("a", "m")).distinct(), "graph-links")
        last, seen = seen, links.agg(*sign).first()
        if seen == last:
            break
    root = names.join(links.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("node", F.coalesce("root", "id").alias("root"))
    return root.join(names.select(F.col("id").alias("root"), F.col("node").alias("component")), "root").select("node", "component")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in, degree)."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.count("*").alias("degree"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ends = nodes.select("node")
    lost = edges.join(ends.withColumnRenamed("node", "src"), "src", "left_anti")
    return lost.unionByName(edges.join(ends.withColumnRenamed("node", "dst"), "dst", "left_anti")).distinct()


def expanded(edges: DataFrame, seeds: DataFrame, depth: int, least: float = 0.0) -> DataFrame:
    """(mode, node, depth, score): what every mode of expansion reaches from the seeds (node) by its kinds of edges, at its smallest distance.

    score is that of the best edge from the step before: confidence times the weight of its type, over 1 + depth. The seeds are left out.
    """
    spark = edges.sparkSession
    modes = F.broadcast(spark.createDataFrame([(m, t) for m, ts in EXPANSIONS.items() for t in ts], "mode string, type string"))
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in EDGE_WEIGHTS.items() for x in pair]), F.col("type")), F.lit(0.8))
    ways = written(edges.where(F.col("confidence") >= least).join(modes, "type").select("mode", "src", "dst", (F.col("confidence") * weight).alias("w")), "graph-ways")
    front = modes.select("mode").distinct().join(seeds.select("node").distinct()).withColumn("depth", F.lit(0)).withColumn("score", F.lit(0.0))  # seeds and modes are few
    seen = written(front, "graph-seen")
    front, out = seen, []
    for d in range(1, depth + 1):
        step = front.select("mode", F.col("node").alias("src")).join(ways, ["mode", "src"]).groupBy("mode", F.col("dst").alias("node")).agg(F.max("w").alias("w"))
        front = written(step.join(seen, ["mode", "node"], "left_anti").select("mode", "node", F.lit(d).alias("depth"), F.round(F.col("w") / (1 + d), 4).alias("score")), "graph-front")
        out.append(front)
        seen = seen.unionByName(front)
    found = out[0]
    for f in out[1:]:
        found = found.unionByName(f)
    return found


def replaced(edges: DataFrame, sources: DataFrame, new: DataFrame) -> DataFrame:
    """edges with all those of the given sources (src) gone and new ones in."""
    return edges.join(sources.distinct(), "src", "left_anti").select(*edges.columns).unionByName(new)
