"""Distances and nearest-neighbour joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import AXES, distance
from .store import cut_lineage

#: A control set of at most this many rows is broadcast; a larger one is joined by grid cells.
BROADCAST_ROWS = 2000


def nearest(points: DataFrame, controls: DataFrame, key: str = "d") -> DataFrame:
    """``points`` (key, z, y, x, ...) with nn: the idx of the nearest control, the lowest of equal ones.

    The number of controls decides how: few are broadcast to the points, many are met in grid cells.
    """
    if controls.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return nearest_by_grid(points, controls, key)
    packed = controls.agg(F.collect_list(F.struct(F.col("idx").alias("nn"), *(F.col(a).cast("double").alias(a) for a in AXES))).alias("controls"))

    def away(control):
        squares = [F.pow(F.col(a) - control[a], 2) for a in AXES]
        return F.struct(F.sqrt(squares[0] + squares[1] + squares[2]).alias("far"), control["nn"].alias("nn"))

    # One row of all controls is broadcast: a projection of the points, without a shuffle.
    best = F.array_min(F.transform("controls", away))
    return points.join(F.broadcast(packed)).select(*points.columns, best["nn"].alias("nn"))


def nearest_by_grid(points: DataFrame, controls: DataFrame, key: str = "d", cell: float | None = None) -> DataFrame:
    """As ``nearest``, by an equality join on cells of a grid that grows until every point has met its control.

    A point meets the controls of its own and the 26 cells around. What it finds within one cell's
    width is nearest for certain; points without that go on with cells twice as wide.
    """
    extent = controls.agg(F.count("*").alias("n"), *(F.max(a).alias(f"h{a}") for a in AXES), *(F.min(a).alias(f"l{a}") for a in AXES)).first()
    spans = [float(extent[f"h{a}"] - extent[f"l{a}"]) for a in AXES]
    size = cell or max(1e-9, (reduce(lambda s, x: s * max(x, 1e-6), spans, 1.0) / max(extent["n"], 1)) ** (1 / 3))
    reach = points.agg(*(F.greatest(F.abs(F.max(a) - F.lit(extent[f"l{a}"])), F.abs(F.lit(extent[f"h{a}"]) - F.min(a))).alias(a) for a in AXES)).first()
    widest = max((float(reach[a] or 0) for a in AXES), default=0.0) * 2 + size
    found: list[DataFrame] = []
    left = points
    while True:
        cells = [F.floor(F.col(a) / size).alias(f"g{a}") for a in AXES]
        c = controls.select(F.col("idx").alias("nn"), *(F.col(a).alias(f"c{a}") for a in AXES), *cells)
        around = left.select("*", *cells)
        for a in AXES:
            around = around.withColumn(f"g{a}", F.explode(F.array(*(F.col(f"g{a}") + step for step in (-1, 0, 1)))))
        p = around.withColumnsRenamed({a: f"p{a}" for a in AXES})
        met = p.join(c, [f"g{a}" for a in AXES]).withColumn("far", distance("p", "c"))
        best = met.groupBy(key).agg(F.min(F.struct("far", "nn")).alias("best"))
        sure = cut_lineage(best if size > widest else best.where(F.col("best.far") <= size))
        found.append(left.join(sure.select(key, F.col("best.nn").alias("nn")), key))
        if size > widest:
            return reduce(DataFrame.unionByName, found)
        left = cut_lineage(left.join(sure, key, "left_anti"))
        size *= 2
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)
