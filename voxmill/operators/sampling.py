"""Reproducible sampling: every draw is a hash of (seed, draw, key)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import hash16, hash60
from .store import cut_lineage


def uniform_draws(spark: SparkSession, n: int, depth: int, height: int, width: int, seed: int) -> DataFrame:
    """(d, z, y, x, u): ``n`` uniform voxels with replacement, each with a threshold from 0..65535."""
    d = F.col("id")
    return spark.range(n).select(
        d.alias("d"),
        (hash16(seed, 0, d) % depth).cast("int").alias("z"),
        (hash16(seed, 1, d) % height).cast("int").alias("y"),
        (hash16(seed, 2, d) % width).cast("int").alias("x"),
        hash16(seed, 3, d).alias("u"),
    )


def accepted_draws(voxels: DataFrame, draws: DataFrame) -> DataFrame:
    """Draws whose voxel is brighter than their threshold, with the brightness v."""
    return draws.join(voxels, ["z", "y", "x"]).where("v > u")


def bright_points(voxels: DataFrame, draws: DataFrame, n: int) -> DataFrame:
    """(idx, z, y, x, v): the first ``n`` accepted draws, numbered from 0 in the order of drawing."""
    first = accepted_draws(voxels, draws).orderBy("d").limit(n)  # n is a parameter: the window has n rows
    return first.select((F.row_number().over(Window.orderBy("d")) - 1).cast("int").alias("idx"), "z", "y", "x", "v")


class BrightnessIndex:
    """Running sums of brightness of a volume (z, y, x, v): over its planes, its rows in a plane, and its voxels in a row.

    A draw is a number below the sum of all brightness, and belongs to the voxel in whose share it lies: it
    is looked up among the planes, then among the rows of its plane, then among the voxels of its row. n
    draws give n points, however dark the volume is, and any range of draws can be made on its own.
    """

    def __init__(self, voxels: DataFrame):
        self.voxels = voxels.where("v > 0")
        self.rows = cut_lineage(self.voxels.groupBy("z", "y").agg(F.sum("v").alias("w")))
        planes = self.rows.groupBy("z").agg(F.sum("w").alias("w")).orderBy("z").toArrow()  # a number for each plane
        self.planes = planes.column("z").to_numpy()
        self.ends = np.cumsum(planes.column("w").to_numpy().astype(np.int64))

    @property
    def total(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def draws(self, first: int, last: int, seed: int) -> DataFrame:
        """(d, z, y, x, v) of the draws from ``first`` up to ``last``: uniform over the brightness, with replacement."""
        spark = self.voxels.sparkSession
        if not self.total:
            raise ValueError("the volume is too dark to be sampled")
        ends, planes = self.ends, self.planes

        def among_planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                r = batch.column("r").to_numpy()
                at = np.searchsorted(ends, r, side="right")
                left = r - np.concatenate(([0], ends))[at]
                yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(planes[at], pa.int32()), pa.array(left)], names=["d", "z", "r"])

        drawn = spark.range(first, last).select(F.col("id").alias("d"), (hash60(seed, 7, F.col("id")) % self.total).alias("r"))
        in_plane = drawn.mapInArrow(among_planes, "d long, z int, r long")
        in_row = in_plane.groupBy("z").cogroup(self.rows.groupBy("z")).applyInArrow(looked_up("z", "y"), "d long, z int, y int, r long, v long")
        held = cut_lineage(in_row.select("d", "z", "y", "r"))
        asked = self.voxels.join(held.select("z", "y").distinct(), ["z", "y"], "left_semi").select("z", "y", "x", F.col("v").cast("long").alias("w"))
        found = held.groupBy("z", "y").cogroup(asked.groupBy("z", "y")).applyInArrow(looked_up("z", "y", "x"), "d long, z int, y int, x int, r long, v long")
        return found.select("d", "z", "y", "x", F.col("v").cast("int").alias("v"))


def looked_up(*keys: str):
    """Draws (d, r) of a group of ``keys`` but the last, among its parts (last key, w): which part's share r lies in, what is left of r, and the part's share."""

    def look_up(key: tuple, draws: pa.Table, parts: pa.Table) -> pa.Table:
        order = np.argsort(parts.column(keys[-1]).to_numpy())
        part, weight = parts.column(keys[-1]).to_numpy()[order], parts.column("w").to_numpy()[order].astype(np.int64)
        ends = np.cumsum(weight)
        r = draws.column("r").to_numpy()
        at = np.searchsorted(ends, r, side="right")
        known = {name: pa.array([value.as_py()] * len(r), pa.int32()) for name, value in zip(keys, key)}
        left, share = (r - (ends - weight)[at], weight[at]) if len(r) else (r, r)
        last = part[at] if len(r) else np.empty(0, np.int32)
        return pa.table({"d": draws.column("d"), **known, keys[-1]: pa.array(last, pa.int32()), "r": pa.array(left, pa.int64()), "v": pa.array(share, pa.int64())})

    return look_up


def bright_sample(voxels: DataFrame, seed: int) -> DataFrame:
    """Each voxel at most once, with a probability in proportion to its brightness; a plain filter."""
    return voxels.where(F.col("v") > hash16(seed, F.col("z"), F.col("y"), F.col("x")))


def refreshed_sample(sample: DataFrame, accepted: DataFrame, k: int, n: int, seed: int) -> DataFrame:
    """``sample`` (idx, z, y, x) after the first ``k`` accepted draws each overwrote a uniform slot of ``n``."""
    draws = accepted.orderBy("d").limit(k).withColumn("idx", (hash16(seed, 4, F.col("d")) % n).cast("int"))
    written = draws.groupBy("idx").agg(F.max_by(F.struct("z", "y", "x"), "d").alias("p")).select("idx", "p.*")
    return sample.select("idx", "z", "y", "x").join(written, "idx", "left_anti").unionByName(written)


def screen_cell(scale: float, height: int) -> list:
    """sy and sx of a voxel on a screen of ``scale`` voxels a cell, which is two rows higher than the volume and turned upside down."""
    rows = int(height / scale + 2)
    return [(rows - 1 - F.floor(F.col("y") / scale)).cast("int").alias("sy"), F.floor(F.col("x") / scale).cast("int").alias("sx")]


def heat_map(hits: DataFrame, scale: float, height: int) -> DataFrame:
    """(sy, sx, hits, heat) on a screen of ``scale`` voxels a cell: n hits brighten a cell to min(255, 10 (2^n - 1))."""
    return hits.groupBy(*screen_cell(scale, height)).agg(F.count("*").alias("hits")).withColumn("heat", heat_of(F.col("hits")))


def heat_of(hits):
    return F.least(F.lit(255), 10 * (F.pow(F.lit(2.0), F.least(hits, F.lit(10))) - 1)).cast("int")


def plane(voxels: DataFrame, z: int, stride: int = 1) -> DataFrame:
    """(y, x, v) of one plane, every ``stride``-th row and column; the filter on z reaches the scan."""
    return voxels.where((F.col("z") == z) & (F.col("y") % stride == 0) & (F.col("x") % stride == 0)).select("y", "x", "v")


def seed_pixels(loadings: DataFrame, draws: DataFrame, owned: DataFrame, scale: float, n: int) -> DataFrame:
    """The first ``n`` draws (d, px, u) whose pixel is free and whose mean loading is at least u / scale."""
    free = draws.join(owned.select("px").distinct(), "px", "left_anti").join(loadings, "px")
    return free.where(F.col("mean_loading") >= F.col("u") / 65536.0 / scale).orderBy("d").limit(n).select("d", "px")
