"""Trees as Euler tours: paths, distances and diameters of trees of any size, in a logarithmic number of rounds.

Every edge is walked once in each direction, and at a node the walk goes on to the neighbour after
the one it came from. That makes one circle of all arcs; ranks along it tell which arc of an edge comes
first, so any node can be made the root by turning the circle, and sums along the circle give
depths and distances. Nodes of any degree are met by sorts alone, never as one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import list_ranks, numbered, running_sums
from .store import cut_lineage

#: Distances that agree to so many digits count as equal, for they are sums in different orders.
DIGITS = 9


def euler_tour(edges: DataFrame) -> DataFrame:
    """(x, y, d, rank, back, arcs): every arc x to y of the tree ``edges`` (u, w, d), its place on the circle, that of its way back, and the number of arcs."""
    both = edges.select(F.col("u").alias("x"), F.col("w").alias("y"), "d").union(edges.select("w", "u", "d"))
    arcs = cut_lineage(numbered(both, ["x", "y"]))
    after = arcs.select((F.col("id") - 1).alias("id"), F.col("x").alias("x_after"))
    first = arcs.groupBy("x").agg(F.min("id").alias("first"))
    # An arc back from y goes on to the neighbour of x that follows y; after the last comes the first again.
    followed = arcs.join(after, "id", "left")
    inner = followed.where("x_after = x").select("x", "y", (F.col("id") + 1).alias("next"))
    last = followed.where("x_after is null or x_after <> x").join(first, "x").select("x", "y", F.col("first").alias("next"))
    ways = inner.unionByName(last).select(F.col("x").alias("y"), F.col("y").alias("x"), "next")
    linked = cut_lineage(arcs.join(ways, ["x", "y"]))
    opened = linked.select("id", F.when(F.col("next") != 0, F.col("next")).alias("next"))  # the circle is cut before arc 0
    ranks = list_ranks(opened)
    many = arcs.agg(F.count("*").alias("arcs"))
    ranked = linked.join(ranks, "id").join(F.broadcast(many)).select("x", "y", "d", (F.col("arcs") - 1 - F.col("after")).alias("rank"), "arcs")
    back = ranked.select(F.col("x").alias("y"), F.col("y").alias("x"), F.col("rank").alias("back"))
    return cut_lineage(ranked.join(back, ["x", "y"]).select("x", "y", "d", "rank", "back", "arcs"))


def rooted(tour: DataFrame, root: int) -> DataFrame:
    """(node, prev, dist, depth, enter, leave) of every node of a tour but ``root``: the node before it on the way from the root, and when the walk comes and goes."""
    start = tour.where(F.col("x") == root).agg(F.min("rank")).first()[0]
    turned = lambda c: F.pmod(F.col(c) - F.lit(start), F.col("arcs"))
    placed = tour.select("x", "y", "d", turned("rank").alias("enter"), turned("back").alias("leave"))
    down = F.col("enter") < F.col("leave")
    signed = placed.select("x", "y", down.alias("down"), "enter", "leave", F.when(down, F.col("d")).otherwise(-F.col("d")).alias("dist"), F.when(down, 1).otherwise(-1).cast("long").alias("depth"))
    summed = running_sums(signed, "enter", ["dist", "depth"])
    return summed.where("down").select(F.col("y").alias("node"), F.col("x").alias("prev"), F.greatest("dist", F.lit(0.0)).alias("dist"), "depth", "enter", "leave")


def with_root(spark: SparkSession, nodes: DataFrame, root: int) -> DataFrame:
    """(node, prev, dist) of ``nodes`` and of the root itself, which has no node before it (-1)."""
    own = spark.createDataFrame([(root, -1, 0.0)], "node long, prev long, dist double")
    types = [nodes.schema["node"].dataType, nodes.schema["prev"].dataType]
    return nodes.select("node", "prev", "dist").unionByName(own.select(F.col("node").cast(types[0]), F.col("prev").cast(types[1]), "dist"))


def tree_reach(edges: DataFrame, root: int) -> DataFrame:
    """(node, prev, dist): every node's parent and path length from ``root``; the root's parent is -1."""
    return with_root(edges.sparkSession, rooted(euler_tour(edges), root), root)


def tip(nodes: DataFrame) -> tuple[int, float]:
    """The node with the longest path, the lowest of equal ones, and that path's length."""
    best = nodes.agg(F.max(F.struct(F.round("dist", DIGITS).alias("far"), (-F.col("node")).alias("low"), "dist")).alias("best")).first()["best"]
    return -best["low"], best["dist"]


def diameter(edges: DataFrame, start: int) -> tuple[int, int, float, DataFrame]:
    """(first tip, second tip, length, path) of a tree of at least one edge, by two sweeps from ``start``; path has (idx, node) from the second tip to the first."""
    spark = edges.sparkSession
    tour = euler_tour(edges)
    first, _ = tip(with_root(spark, rooted(tour, start), start))
    swept = cut_lineage(rooted(tour, first))
    second, length = tip(with_root(spark, swept, first))
    if second == first:  # all edges have no length
        return first, second, length, spark.createDataFrame([(0, first)], "idx int, node int")
    end = swept.where(F.col("node") == second).first()
    # On the way are the nodes that the walk has come to and not yet left when it comes to the second tip.
    above = swept.where((F.col("enter") <= end["enter"]) & (F.col("leave") >= end["leave"]))
    along = above.select((end["depth"] - F.col("depth")).cast("int").alias("idx"), F.col("node").cast("int").alias("node"))
    return first, second, length, along.unionByName(spark.createDataFrame([(end["depth"], first)], "idx int, node int"))
