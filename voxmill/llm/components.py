"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import Rounds
from .common import is_empty, materialize, shuffles_removed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); the component is its smallest node.

    Alternates two steps until only stars are left: every node links its larger neighbours to the
    smallest node it knows (large star), then its smaller neighbours likewise (small star). A step
    only keeps as many edges as it got, and the number of rounds grows with the logarithm of the
    graph's size. There is no limit to the rounds, so no component is left divided. The driver sees
    one row per round. Edges are held from the larger node to the smaller, and only nodes with
    a smaller neighbour are looked up. The edges of a star meet at its centre in joins to a table
    with one row per node, so Spark may split them among tasks where they are many. Edges are files
    in every round: both uses of a step share the shuffles before it then, and few rows are read by few tasks.
    """
    rounds = Rounds(edges.sparkSession)

    def held(table: DataFrame) -> DataFrame:
        with shuffles_removed(table.sparkSession):
            return rounds.next(table)

    edges = held(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not only_stars(edges):
        lower = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        # Repeated edges are left until both steps are done: there are no more rows than edges before.
        large = edges.join(lower, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        pairs = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = pairs.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("edge"))
        edges = held(small.select("edge.a", "edge.b").where("a <> b").distinct())
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres))
    rounds.end()
    return found


def only_stars(edges: DataFrame) -> bool:
    """Whether every larger node of ``edges`` (a, b) has one edge, and no smaller node is the larger one of another."""
    ends = F.array(*(F.struct(F.col(c).alias("node"), F.lit(c == "a").cast("int").alias("up"), F.lit(c == "b").cast("int").alias("down")) for c in "ab"))
    counted = edges.select(F.explode(ends).alias("end")).groupBy("end.node").agg(F.sum("end.up").alias("up"), F.sum("end.down").alias("down"))
    return is_empty(counted.where("up > 1 or (up = 1 and down > 0)"))
