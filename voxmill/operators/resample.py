"""Resampling of a volume at arbitrary points, and the straightened volume along a line."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import AXES, voxel_value
from ..params import StraightenParams
from . import bricks


@dataclass(frozen=True)
class Shape:
    depth: int
    height: int
    width: int

    @property
    def sizes(self) -> tuple[tuple[str, int], ...]:
        return tuple(zip(AXES, (self.depth, self.height, self.width), strict=True))


@dataclass(frozen=True)
class OutputShape:
    depth: int
    height: int
    width: int
    extra: int
    slice: int | None


def output_shape(source: Shape, length: float, params: StraightenParams) -> OutputShape:
    """A quarter of the source's width, the line's length with as much again at both ends, and an even depth."""
    width = source.width // 4 if params.out_width == -1 else params.out_width
    extra = width if params.out_extra == -1 else params.out_extra
    height = int(length) + 2 * extra if params.out_height == -1 else params.out_height
    if params.out_slice != -1:
        return OutputShape(1, height, width, extra, params.out_slice)
    if source.depth < 4:
        raise ValueError("a volume of few planes needs a slice")
    return OutputShape((source.depth // 2 - 1) * 2, height, width, extra, None)


def sample_points(frames: DataFrame, out: OutputShape, source_depth: int) -> DataFrame:
    """(k, j, i, z, y, x): where each output voxel lies in the source; frames are broadcast to the grid.

    A closed form replaces the step by step walk: any part of the grid can be computed on its own.
    """
    spark = frames.sparkSession
    cells = spark.range(out.depth * out.height * out.width)
    plane = out.height * out.width
    grid = cells.select(
        F.floor(F.col("id") / plane).cast("int").alias("k"),
        (F.floor(F.col("id") / out.width) % out.height).cast("int").alias("j"),
        (F.col("id") % out.width).cast("int").alias("i"),
    )
    along = F.col("k") - out.depth / 2 if out.slice is None else F.lit(float(out.slice - source_depth // 2))
    across = F.col("i") - out.width / 2
    places = [(F.col(f"p{a}") + along * F.col(f"n{a}") + across * F.col(f"u{a}")).alias(a) for a in AXES]
    return grid.join(F.broadcast(frames), "j").select("k", "j", "i", *places)  # one frame per output row


def inside(shape: Shape, corners: bool) -> Column:
    """Whether a point's voxel is in the volume, with its upper neighbours if ``corners``; one plane is depth 0."""
    result = F.lit(True)
    for axis, size in shape.sizes:
        upper = size - 1 if corners and size > 1 else size
        result = result & (F.col(f"i{axis}") >= 0) & (F.col(f"i{axis}") < upper)
    return result


def trilinear(points: DataFrame, voxels: DataFrame, shape: Shape, keys: list[str]) -> DataFrame:
    """``keys`` and val: the volume at real coordinates (z, y, x), 0 outside.

    Every point goes to the brick that holds its eight corners and is interpolated there; points
    outside are answered where they lie.
    """
    return with_zeros(points, inside(shape, True), F.floor, voxels, shape, keys)


def nearest_voxel(points: DataFrame, voxels: DataFrame, shape: Shape, keys: list[str]) -> DataFrame:
    """``keys`` and val: the voxel nearest to each point, halves to the even side, 0 outside."""
    return with_zeros(points, inside(shape, False), F.rint, voxels, shape, keys)


def with_zeros(points: DataFrame, hit: Column, whole: Callable[[str], Column], voxels: DataFrame, shape: Shape, keys: list[str]) -> DataFrame:
    """Values of ``points``: read from bricks where ``hit``, else 0; ``whole`` gives the voxel of a coordinate."""
    cut = points.select(*keys, *AXES, *(whole(a).cast("long").alias(f"i{a}") for a in AXES))
    own = {a: F.col(f"i{a}") for a in AXES}
    between = {a: F.greatest(F.col(a) - own[a], F.lit(0.0)) if whole is F.floor and size > 1 else F.lit(0.0) for a, size in shape.sizes}
    hits = F.coalesce(hit, F.lit(False))
    found = bricks.gather(cut.where(hits), bricks.bricks_of(voxels.where(within(shape))), keys, own, between)
    return found.unionByName(cut.where(~hits).select(*keys, F.lit(0.0).alias("val")))


def within(shape: Shape) -> Column:
    """Whether a voxel (z, y, x) lies in the volume."""
    return reduce(Column.__and__, ((F.col(a) >= 0) & (F.col(a) < size) for a, size in shape.sizes))


def as_voxels(values: DataFrame) -> DataFrame:
    """(z, y, x, v) from (k, j, i, val): cut to 16 bit."""
    return values.select(F.col("k").alias("z"), F.col("j").alias("y"), F.col("i").alias("x"), voxel_value(F.col("val")).alias("v"))
