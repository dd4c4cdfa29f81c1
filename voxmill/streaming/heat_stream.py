"""The sampling heat map on an unbounded stream of draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import hash16
from ..operators.sampling import accepted_draws, heat_map
from ..sources import draw_stream


def endless_draws(spark: SparkSession, depth: int, height: int, width: int, seed: int, **options: int) -> DataFrame:
    """The draws of ``sampling.uniform_draws`` as a stream; for the options see ``draw_stream``."""
    draw_stream.register(spark)
    return draws_of(spark.readStream.format("draws").options(**options).load(), depth, height, width, seed)


def draws_of(stream: DataFrame, depth: int, height: int, width: int, seed: int) -> DataFrame:
    """A voxel and a threshold for each event of ``stream`` (value: a running number)."""
    d = F.col("value")
    return stream.select(
        d.alias("d"),
        (hash16(seed, 0, d) % depth).cast("int").alias("z"),
        (hash16(seed, 1, d) % height).cast("int").alias("y"),
        (hash16(seed, 2, d) % width).cast("int").alias("x"),
        hash16(seed, 3, d).alias("u"),
    )


def heat_stream(draws: DataFrame, voxels: DataFrame, scale: float, height: int) -> DataFrame:
    """(sy, sx, hits, heat) of the accepted draws so far, for output in update or complete mode.

    The state has one row per screen cell, so it is bounded by the screen and needs no watermark.
    """
    return heat_map(accepted_draws(voxels, draws), scale, height)
