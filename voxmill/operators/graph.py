"""Spanning trees, and the line along the longest path of one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import AXES, distance
from .store import Rounds, cut_lineage
from .tours import diameter

#: Points up to which all pairs are listed (two million); more meet in the cells of a grid.
ALL_PAIRS = 2000
#: Points of the densest cell of the grid at first.
CELL_POINTS = 64


def minimum_spanning_tree(points: DataFrame) -> DataFrame:
    """(u, w, d), u < w: the minimum spanning tree of ``points`` (idx, z, y, x); of edges of equal length the lower (u, w) comes first."""
    if len(points.select("idx").limit(ALL_PAIRS + 1).collect()) > ALL_PAIRS:
        return tree_by_distance(points)
    held = cut_lineage(points.select("idx", *AXES))
    return boruvka(pairwise_distances(held))


def pairwise_distances(points: DataFrame) -> DataFrame:
    """(u, w, d) for all pairs u < w of ``points`` (idx, z, y, x); meant for sample-sized sets."""
    a = points.select(F.col("idx").alias("u"), *(F.col(c).alias(f"a{c}") for c in AXES))
    b = points.select(F.col("idx").alias("w"), *(F.col(c).alias(f"b{c}") for c in AXES))
    return a.join(b, F.col("u") < F.col("w")).select("u", "w", distance("a", "b").alias("d"))


def cells_of(reach: float, prefix: str = "") -> list:
    """The grid cell of width ``reach`` that a point lies in."""
    return [F.floor(F.col(f"{prefix}{a}") / reach).alias(f"g{a}") for a in AXES]


def around(df: DataFrame) -> DataFrame:
    """Every row in its own cell and in the 26 about it."""
    for a in AXES:
        df = df.withColumn(f"g{a}", F.explode(F.array(*(F.col(f"g{a}") + step for step in (-1, 0, 1)))))
    return df


def close_pairs(probes: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """(u, w, d), u < w: of every two comps of ``probes`` and ``points`` (idx, comp, z, y, x) the first edge within ``reach``, by (d, u, w).

    Points meet in grid cells of that width, and only where the cell and those about it hold more than one
    comp: the inside of a cluster that shorter edges have connected is not listed again. Of the edges between
    two comps no other than the first can be in the tree, so a task passes on one for each two.
    """
    cells = [f"g{a}" for a in AXES]
    placed = points.select("idx", "comp", *AXES, *cells_of(reach))
    spans = around(placed.groupBy(*cells).agg(F.min("comp").alias("low"), F.max("comp").alias("high")))
    mixed = spans.groupBy(*cells).agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select(*cells)
    right = placed.join(mixed, cells, "left_semi").select(F.col("idx").alias("w"), F.col("comp").alias("cw"), *(F.col(a).alias(f"b{a}") for a in AXES), *cells)
    left = probes.select(F.col("idx").alias("u"), F.col("comp").alias("cu"), *(F.col(a).alias(f"a{a}") for a in AXES), *cells_of(reach))
    met = around(left.join(mixed, cells, "left_semi")).join(right, cells).where("cu <> cw").withColumn("d", distance("a", "b")).where(F.col("d") <= reach)
    edge = F.struct("d", F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w"))
    first = met.groupBy(F.least("cu", "cw").alias("low"), F.greatest("cu", "cw").alias("high")).agg(F.min(edge).alias("e"))
    return first.select("e.u", "e.w", "e.d")


def first_reach(points: DataFrame) -> float:
    """A length at which pairs stay in proportion to points: about the distance of neighbours where most are, and less while some cell holds many."""
    low, quarter, most, high = np.transpose(points.approxQuantile(list(AXES), [0.0, 0.25, 0.75, 1.0], 0.01))
    reach = float((np.prod(np.maximum(most - quarter, 1e-3)) / max(points.count() / 8, 1)) ** (1 / 3))
    finest = float(np.abs([low, high]).max()) * 2.0**-40  # cells are still told apart
    while reach > finest:
        densest = points.groupBy(*cells_of(reach)).count().agg(F.max("count")).first()[0] or 0
        if densest <= CELL_POINTS:
            break
        reach /= max(2.0, (densest / CELL_POINTS) ** (1 / 3))
    return reach


def tree_by_distance(points: DataFrame) -> DataFrame:
    """(u, w, d): a minimum spanning tree of points whose pairs are too many to be listed.

    Edges up to a length are found by a grid and connect what they can; then longer ones are looked
    for, but only from the points outside the largest component. An edge that is longer than another
    is never needed between parts that shorter ones connect, so the result is that of all pairs.
    """
    # Points in one place hang on the lowest of them, by edges that come before all others.
    placed = points.select("idx", *AXES)
    lowest = cut_lineage(placed.groupBy(*AXES).agg(F.min("idx").alias("idx")))
    hanging = placed.withColumnRenamed("idx", "w").join(lowest.withColumnRenamed("idx", "u"), list(AXES)).where("u <> w")
    apart = tree_of_places(lowest)
    return apart.unionByName(hanging.select("u", "w", F.lit(0.0).alias("d")))


def tree_of_places(points: DataFrame) -> DataFrame:
    """As ``tree_by_distance``, of points no two of which lie in one place."""
    reach = first_reach(points)
    placed = cut_lineage(points.select("idx", *AXES))
    labels = cut_lineage(placed.select(F.col("idx").alias("node"), F.col("idx").alias("comp")))
    picked: DataFrame | None = None
    while True:
        labelled = placed.join(labels, F.col("idx") == F.col("node")).select("idx", "comp", *AXES)
        sizes = labels.groupBy("comp").count().orderBy(F.desc("count"), "comp").limit(2).collect()
        if len(sizes) < 2:
            return picked if picked is not None else points.sparkSession.createDataFrame([], "u int, w int, d double")
        pairs = cut_lineage(close_pairs(labelled.where(F.col("comp") != sizes[0]["comp"]), labelled, reach))
        if not pairs.isEmpty():
            new, labels = merge_rounds(pairs, labels)
            picked = new if picked is None else cut_lineage(picked.unionByName(new))
        reach *= 2


def boruvka(edges: DataFrame) -> DataFrame:
    """(u, w, d): a minimum spanning forest of the undirected ``edges`` (u, w, d), by rounds of joins."""
    edges = cut_lineage(edges)
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("w").alias("node"))).distinct()
    picked, _ = merge_rounds(edges, cut_lineage(nodes.withColumn("comp", F.col("node"))))
    return picked if picked is not None else edges.limit(0)


def merge_rounds(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(picked edges or None, labels) once no edge of ``edges`` (u, w, d) leads to another component of ``labels`` (node, comp).

    Every component picks its least edge, by (d, u, w); picked edges join components, whose labels
    then shrink to one by pointer jumping. The number of components at least halves in a round.
    """
    picked: DataFrame | None = None
    spark = edges.sparkSession
    rounds = Rounds(spark)
    while True:
        a = labels.select(F.col("node").alias("u"), F.col("comp").alias("cu"))
        b = labels.select(F.col("node").alias("w"), F.col("comp").alias("cw"))
        crossing = edges.join(a, "u").join(b, "w").where("cu <> cw")
        key = F.struct("d", "u", "w", "cu", "cw")
        sides = crossing.select(F.col("cu").alias("comp"), F.col("cw").alias("to"), key.alias("e")).union(
            crossing.select(F.col("cw").alias("comp"), F.col("cu").alias("to"), key.alias("e"))
        )
        least = Rounds(spark).next(sides.groupBy("comp").agg(F.min_by("to", F.struct("e.d", "e.u", "e.w")).alias("to"), F.min(F.struct("e.d", "e.u", "e.w")).alias("e")))
        if least.isEmpty():
            return picked, labels
        new = least.select("e.u", "e.w", "e.d").distinct()
        picked = new if picked is None else picked.unionByName(new)
        parents = roots(least)
        labels = rounds.next(labels.join(parents, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))


def roots(least: DataFrame) -> DataFrame:
    """(comp, root) of components that each point at another (comp, to), by pointer jumping; of two that point at each other, the lower is the root."""
    back = least.select(F.col("comp").alias("to"), F.col("to").alias("back"))
    parents = least.select("comp", "to").join(back, "to", "left")
    parents = parents.select("comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("root"))
    rounds = Rounds(least.sparkSession)
    parents = rounds.next(parents.distinct())
    while True:
        up = parents.select(F.col("comp").alias("root"), F.col("root").alias("next"))
        jumped = rounds.next(parents.join(up, "root").select("comp", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        parents = jumped.select("comp", "root")
        if jumped.where("moved").isEmpty():
            return parents


def backbone(spark: SparkSession, points: DataFrame) -> DataFrame:
    """(idx, node, z, y, x): the points along the diameter of the spanning tree, renumbered from 0."""
    held = cut_lineage(points.select("idx", *AXES))
    least = held.agg(F.min("idx")).first()[0]
    edges = minimum_spanning_tree(held)
    if edges.isEmpty():
        along = held.select(F.lit(0).alias("idx"), F.col("idx").cast("int").alias("node"))  # one point or none
    else:
        along = diameter(edges, least)[3]
    places = held.select(F.col("idx").alias("node"), *(F.col(a).cast("double").alias(a) for a in AXES))
    return along.join(places, "node").select("idx", "node", *AXES)
