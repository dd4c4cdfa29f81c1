"""The programs, from a volume to their results."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import AXES, voxel_value
from ..operators import contour, factor, graph, grow, resample, sampling, spectrum, spline, stats, store
from ..params import DimensionsParams, SamplerParams, StraightenParams, SvdParams


def infer_shape(series: DataFrame, length: int, params: DimensionsParams) -> DataFrame:
    """Candidate shapes of a raw series (i, v) of ``length`` values, the likeliest first."""
    n = min(params.fourier_n, length)
    correlation = spectrum.autocorrelation(series, n, params.max_dim)
    return spectrum.shape_candidates(correlation, length, n, params.max_dim).orderBy(F.desc_nulls_last("score"), "height")


def sample_heat(spark: SparkSession, voxels: DataFrame, depth: int, draws: int, params: SamplerParams, seed: int = 42) -> DataFrame:
    """The heat map after a number of draws."""
    drawn = sampling.uniform_draws(spark, draws, depth, params.height, params.width, seed)
    return sampling.heat_map(sampling.accepted_draws(voxels, drawn), params.scale, params.height)


@dataclass(frozen=True)
class Straightened:
    backbone: np.ndarray
    iterations: int
    frames: DataFrame
    volume: DataFrame
    shape: resample.OutputShape


#: Draws of the volume that the contour loop gets at a time.
DRAW_BLOCK = 20_000


def find_backbone(spark: SparkSession, voxels: DataFrame, params: StraightenParams, attempts: int = 5) -> tuple[np.ndarray, int]:
    """(controls, iterations): spanning tree of a bright sample, its diameter, and the refined line along it."""
    index = sampling.BrightnessIndex(voxels)
    for attempt in range(attempts):
        seed = params.seed + 2 * attempt
        sample = store.cut_lineage(index.draws(0, params.mst_points, seed).select(F.col("d").cast("int").alias("idx"), *AXES))
        path = np.array([[row[a] for a in AXES] for row in graph.backbone(spark, sample).orderBy("idx").collect()], dtype=float)

        def fetch(first: int, last: int, seed=seed) -> tuple[np.ndarray, np.ndarray]:
            rows = index.draws(first, last, seed + 1).orderBy("d").toArrow()  # a block of draws
            places = np.stack([rows.column(a).to_numpy() for a in AXES], axis=1).astype(float)
            return places, rows.column("v").to_numpy().astype(float) if params.weighted else np.ones(len(places))

        if len(path) < 2:
            continue  # a sample of one point has no line
        draws = contour.Draws(fetch, max(params.contour_points, DRAW_BLOCK))
        line, iterations, converged = contour.refine_line(path, draws, params)
        if converged:
            return line, iterations
    raise ValueError(f"no line settled in {attempts} attempts")


def straighten(spark: SparkSession, voxels: DataFrame, shape: resample.Shape, params: StraightenParams, controls: np.ndarray | None = None) -> Straightened:
    """Find the centre line (or take ``controls``) and resample the volume along it."""
    line, iterations = (controls, 0) if controls is not None else find_backbone(spark, voxels, params)
    curve = spline.natural_spline(np.asarray(line, dtype=float))
    out = resample.output_shape(shape, curve.length, params)
    rows = spark.range(out.height).select(F.col("id").cast("int").alias("j"), (F.col("id") - out.extra).cast("double").alias("s"))
    frames = spline.spline_frames(rows, spline.spline_table(spark, curve))
    points = resample.sample_points(frames, out, shape.depth)
    gather = resample.trilinear if params.interpolate else resample.nearest_voxel
    return Straightened(line, iterations, frames, resample.as_voxels(gather(points, voxels, shape, ["k", "j", "i"])), out)


@dataclass(frozen=True)
class Cells:
    """Factors, masks as grown and as scaled, signals as summed and as scaled (``traces``), colours, and coloured frames."""

    svd: factor.Svd
    masks: grow.Masks
    scaled: DataFrame
    signals: DataFrame
    traces: DataFrame
    colours: DataFrame
    pixel_colours: DataFrame
    frames: DataFrame


def factors(px: DataFrame, time: int, dim: int, cache: str | None = None) -> factor.Svd:
    """The first ``dim`` components of a stack; kept under ``cache``, and read from there if those of the same stack and parameters were kept before."""
    spark = px.sparkSession
    if cache is None:
        return factor.truncated_svd(px, time, dim)
    label = {"time": time, "dim": dim, **content(px)}
    if kept_label(spark, cache) != label:
        factor.save(factor.truncated_svd(px, time, dim), cache)
        spark.createDataFrame([(json.dumps(label, sort_keys=True),)], "label string").coalesce(1).write.mode("overwrite").parquet(f"{cache}/label")
    return factor.load(spark, cache)


def content(px: DataFrame) -> dict[str, str]:
    """Number of cells, their sum and two sums of hashes: what tells a stack (px, t, v) from another."""
    cell = F.struct(F.col("px").cast("long"), F.col("t").cast("long"), F.col("v").cast("double"))
    wide = lambda h: F.sum(h.cast("decimal(20, 0)"))
    row = px.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38, 6)")), wide(F.xxhash64(cell)), wide(F.xxhash64(F.lit(1), cell))).first()
    return dict(zip(("cells", "sum", "first", "second"), map(str, row), strict=True))


def kept_label(spark: SparkSession, cache: str) -> dict | None:
    """What the factors under ``cache`` were made of; the label is written last, so without it they are not whole."""
    try:
        return json.loads(spark.read.parquet(f"{cache}/label").first()["label"])
    except AnalysisException:
        return None


def find_cells(spark: SparkSession, px: DataFrame, time: int, params: SvdParams, cache: str | None = None) -> Cells:
    """Masks of pixels with alike traces, their traces, and coloured frames, from a stack (px, t, v)."""
    svd = factors(px, time, params.dim, cache)
    masks = grow.grow_masks(spark, svd.u, params)
    weights = svd.u.join(F.broadcast(svd.s.withColumnRenamed("val", "s")), "k").where(F.col("k").between(1, params.colors - 1))
    weights = weights.select("row", "k", (F.col("val") * F.col("s")).alias("val"))
    components = weights.join(F.broadcast(masks.seed), "row").select("m", "k", "val")
    signals = components.join(svd.vt.withColumnRenamed("val", "vt"), "k").groupBy("m", "t").agg(F.sum(F.col("val") * F.col("vt")).alias("val"))
    directions = stats.component_directions(svd.s, params.seed)
    shares = components.withColumn("val", F.col("val") / (50 * params.colors))
    colours = stats.scaled_saturation(stats.component_colours(shares, directions, "m"))
    pixel_colours = stats.scaled_saturation(stats.component_colours(weights, directions, "row"))
    scaled = stats.rescaled_masks(masks.mask, params.masks * params.width * params.height)
    traces = stats.rescaled_signals(signals)
    return Cells(svd, masks, scaled, signals, traces, colours, pixel_colours, stats.additive_blend(scaled, traces, colours))


def colour_shapes(px: DataFrame, time: int, params: SvdParams, cache: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(reconstruction (row, t, v), shapes (row, r, g, b)) of a stack by its first components."""
    svd = factors(px, time, params.dim, cache)
    weights = svd.u.join(F.broadcast(svd.s.withColumnRenamed("val", "s")), "k").select("row", "k", (F.col("val") * F.col("s")).alias("val"))
    coloured = stats.component_shapes(weights.where(F.col("k").between(1, params.colors - 1)), stats.palette(svd.s, params.seed), params.colors)
    return factor.reconstruct(svd).select("row", "t", voxel_value(F.col("val")).alias("v")), coloured
