"""Regions of neighbouring pixels, labelled tile by tile and merged over the tiles' borders.

A tile is labelled in one task; labels of pixels that meet at a border are one edge of a graph
whose components are the regions. Rounds follow the number of tiles that a region winds through, as its logarithm,
not the number of its pixels. Many planes are labelled in one pass, told apart by ``m``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import merge_rounds
from .store import cut_lineage

#: Pixels along the side of a tile.
SIDE = 64
STEPS = ((0, 1), (0, -1), (1, 0), (-1, 0))


def tile_labels(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each pixel of a tile, the index of one pixel of its region, the same for the whole region."""
    field = np.full((SIDE + 1, SIDE + 1), -1)
    field[y, x] = np.arange(len(y))
    pairs = [(field[:, :-1], field[:, 1:]), (field[:-1], field[1:])]
    a = np.concatenate([p[(p >= 0) & (q >= 0)] for p, q in pairs])
    b = np.concatenate([q[(p >= 0) & (q >= 0)] for p, q in pairs])
    label = np.arange(len(y))
    while True:
        high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        differ = high != low
        if not differ.any():
            return label
        np.minimum.at(label, high[differ], low[differ])
        while (label[label] != label).any():
            label = label[label]


def labelled(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pixels (m, y, x, label), labels (node, comp)) of ``pixels`` (m, y, x): pixels of one label are connected, labels of one comp too.

    Both are written to the checkpoint folder; a label is a number over all planes.
    """
    held = cut_lineage(pixels.select("m", "y", "x").distinct())
    ends = held.agg(*(f(c).alias(f"{n}{c}") for n, f in (("low", F.min), ("high", F.max)) for c in ("m", "y", "x"))).first()
    low = {c: ends[f"low{c}"] or 0 for c in ("m", "y", "x")}
    rows, columns = (((ends[f"high{c}"] or 0) - low[c] + 1) for c in ("y", "x"))

    def label(key: tuple, own: pa.Table) -> pa.Table:
        y, x = (own.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
        first = tile_labels(y % SIDE, x % SIDE)
        number = ((own.column("m").to_numpy().astype(np.int64) - low["m"]) * rows + (y - low["y"])) * columns + (x - low["x"])
        return own.select(["m", "y", "x"]).append_column("label", pa.array(number[first]))

    tiles = held.groupBy("m", F.floor(F.col("y") / SIDE).alias("ty"), F.floor(F.col("x") / SIDE).alias("tx"))
    found = cut_lineage(tiles.applyInArrow(label, "m int, y int, x int, label long"))
    edges = []
    for axis in ("y", "x"):
        before = found.where(F.pmod(F.col(axis), F.lit(SIDE)) == SIDE - 1).withColumn(axis, F.col(axis) + 1).withColumnRenamed("label", "u")
        after = found.where(F.pmod(F.col(axis), F.lit(SIDE)) == 0).withColumnRenamed("label", "w")
        edges.append(before.join(after, ["m", "y", "x"]).select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w")))
    met = cut_lineage(edges[0].unionByName(edges[1]).distinct().withColumn("d", F.lit(0.0)))
    labels = found.select(F.col("label").alias("node")).distinct().withColumn("comp", F.col("node"))
    if met.isEmpty():
        return found, labels
    return found, merge_rounds(met, cut_lineage(labels))[1]


def reached(pixels: DataFrame, seeds: DataFrame) -> DataFrame:
    """(m, y, x): ``pixels`` (m, y, x) that four-neighbour steps over pixels reach from ``seeds`` (m, y, x).

    A seed itself is in only if it is a pixel and has a neighbour that is one.
    """
    found, labels = labelled(pixels)
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in STEPS))
    stepped = seeds.select("m", "y", "x", F.explode(steps).alias("step"))
    around = stepped.select("m", (F.col("y") + F.col("step.dy")).alias("y"), (F.col("x") + F.col("step.dx")).alias("x")).distinct()
    entered = found.join(around, ["m", "y", "x"]).select(F.col("label").alias("node")).distinct()
    comps = labels.join(entered, "node").select("comp").distinct()
    nodes = labels.join(comps, "comp", "left_semi").select(F.col("node").alias("label"))
    return found.join(nodes, "label").select("m", "y", "x")
