"""Natural cubic splines over chord length, and the frames along them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import AXES


def chord_lengths(controls: DataFrame) -> DataFrame:
    """``controls`` with s: the path length up to each, along straight chords in the order of idx."""
    order = Window.orderBy("idx")
    squares = [F.pow(F.col(a) - F.lag(a).over(order), 2) for a in AXES]
    stepped = controls.withColumn("step", F.coalesce(F.sqrt(squares[0] + squares[1] + squares[2]), F.lit(0.0)))
    return stepped.withColumn("s", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


@dataclass(frozen=True)
class Spline:
    """Knots s, values y (knots x axes) and second derivatives m."""

    s: np.ndarray
    y: np.ndarray
    m: np.ndarray

    @property
    def length(self) -> float:
        return float(self.s[-1])

    def coefficients(self) -> tuple[np.ndarray, ...]:
        """a, b, c, d per segment and axis: y = a + b t + c t^2 + d t^3 with t from the segment's start."""
        h = np.diff(self.s)[:, None]
        a, c = self.y[:-1], self.m[:-1] / 2
        d = np.diff(self.m, axis=0) / (6 * h)
        b = np.diff(self.y, axis=0) / h - h * (2 * self.m[:-1] + self.m[1:]) / 6
        return a, b, c, d


def natural_spline(points: np.ndarray) -> Spline:
    """The natural cubic spline through ``points`` (knots x axes) over their chord length.

    A point that repeats the one before it is left out; knots are as many as a line has controls.
    """
    keep = np.concatenate(([True], (np.diff(points, axis=0) != 0).any(axis=1)))
    y = points[keep]
    if len(y) < 2:
        raise ValueError("a spline needs two different points")
    h = np.sqrt((np.diff(y, axis=0) ** 2).sum(axis=1))
    s = np.concatenate(([0.0], np.cumsum(h)))
    m = np.zeros_like(y)
    n = len(y) - 2
    if n:
        system = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
        slopes = np.diff(y, axis=0) / h[:, None]
        m[1:-1] = np.linalg.solve(system, 6 * np.diff(slopes, axis=0))
    return Spline(s, y, m)


def spline_table(spark: SparkSession, spline: Spline) -> DataFrame:
    """(axis, i, s0, s1, a, b, c, d) per axis and segment."""
    a, b, c, d = spline.coefficients()
    rows = [
        (AXES[k], i, *(float(v) for v in (spline.s[i], spline.s[i + 1], a[i, k], b[i, k], c[i, k], d[i, k])))
        for k in range(a.shape[1])
        for i in range(len(a))
    ]
    return spark.createDataFrame(rows, "axis string, i int, s0 double, s1 double, a double, b double, c double, d double")


def spline_frames(positions: DataFrame, segments: DataFrame) -> DataFrame:
    """Frames at arclengths s of ``positions`` (j, s): point p, unit row direction u, unit depth direction n.

    The segment is found by a range join against the broadcast segments of one line. Outside the
    knots the line goes on straight from its end. u lies across the line in the plane of a slice; where the
    line runs along z it has no direction, and the frame of the row before is used.
    """
    ends = segments.agg(F.min("s0").alias("low"), F.max("s1").alias("high"))
    at = positions.join(F.broadcast(ends)).withColumn("inside", F.least(F.greatest("s", "low"), F.col("high")))
    wide = segments.groupBy("i", "s0", "s1").agg(
        *(F.max(F.when(F.col("axis") == axis, F.col(k))).alias(f"{k}{axis}") for axis in AXES for k in "abcd")
    )
    hit = (F.col("inside") >= F.col("s0")) & ((F.col("inside") < F.col("s1")) | ((F.col("inside") == F.col("high")) & (F.col("s1") == F.col("high"))))
    found = at.join(F.broadcast(wide), hit)
    t, over = F.col("inside") - F.col("s0"), F.col("s") - F.col("inside")
    columns = ["j"]
    for axis in AXES:
        a, b, c, d = (F.col(f"{k}{axis}") for k in "abcd")
        slope = b + t * (2 * c + t * 3 * d)
        columns += [(a + t * (b + t * (c + t * d)) + over * slope).alias(f"p{axis}"), slope.alias(f"d{axis}")]
    tangents = found.select(*columns)
    across = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    framed = tangents.withColumn("uy", F.when(across > 0, F.col("dx") / across)).withColumn("ux", F.when(across > 0, -F.col("dy") / across))
    last = Window.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)  # one row per output row of a line
    framed = framed.withColumn("uy", F.coalesce(F.last("uy", True).over(last), F.lit(0.0))).withColumn("ux", F.coalesce(F.last("ux", True).over(last), F.lit(1.0)))
    nz, ny, nx = F.col("uy") * F.col("dx") - F.col("ux") * F.col("dy"), F.col("ux") * F.col("dz"), -F.col("uy") * F.col("dz")
    size = F.sqrt(nz * nz + ny * ny + nx * nx)
    normal = [F.when(size > 0, part / size).otherwise(0.0).alias(name) for part, name in ((nz, "nz"), (ny, "ny"), (nx, "nx"))]
    return framed.select("j", "pz", "py", "px", F.lit(0.0).alias("uz"), "uy", "ux", *normal)
