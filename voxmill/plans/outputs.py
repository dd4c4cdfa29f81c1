"""What the programs write: raw volumes, coloured planes, and a folder of cells.

Files are written by the tasks that hold their content, into a folder that driver and executors share.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import csl_to_rgb
from ..functions.geometry import voxel_value
from ..operators import factor
from ..params import SvdParams
from ..sources import images, raw_volume, text_files
from .programs import Cells, Straightened

RGB = ("r", "g", "b")


def place(width: int) -> list[Column]:
    """y and x of a row number."""
    return [F.floor(F.col("row") / width).cast("int").alias("y"), (F.col("row") % width).cast("int").alias("x")]


def write_straightened(result: Straightened, path: str) -> None:
    """The straightened volume as a raw file of the output's shape."""
    raw_volume.write_raw(result.volume, path, result.shape.depth, result.shape.height, result.shape.width)


def write_reconstruction(values: DataFrame, path: str, time: int, params: SvdParams) -> None:
    """A reconstruction (row, t, v) as a raw file, a plane per time."""
    raw_volume.write_raw(values.select(F.col("t").alias("z"), *place(params.width), "v"), path, time, params.height, params.width)


def write_shapes(coloured: DataFrame, path: str, params: SvdParams) -> None:
    """Coloured pixels (row, r, g, b) as a raw file of three bytes a pixel."""
    raw_volume.write_rgb(coloured.select(*place(params.width), *RGB), path, params.height, params.width)


def component_stack(svd: factor.Svd) -> DataFrame:
    """(row, k, v): how strongly each component shows in each row, cut to 16 bit."""
    strength = svd.u.join(F.broadcast(svd.s.withColumnRenamed("val", "s")), "k")
    return strength.select("row", "k", voxel_value(F.col("val") * F.col("s")).alias("v"))


def write_component_stack(svd: factor.Svd, path: str, params: SvdParams) -> None:
    """A raw file with a plane per component."""
    stack = component_stack(svd).select(F.col("k").alias("z"), *place(params.width), "v")
    raw_volume.write_raw(stack, path, params.dim, params.height, params.width)


def dense_stack(px: DataFrame, time: int, params: SvdParams) -> DataFrame:
    """(z, row, v) of all cells of a sparse stack (px, t, v)."""
    cells = px.sparkSession.range(time * params.width * params.height)
    pixels = params.width * params.height
    every = cells.select(F.floor(F.col("id") / pixels).cast("int").alias("z"), (F.col("id") % pixels).alias("row"))
    known = px.select(F.col("t").alias("z"), F.col("px").cast("long").alias("row"), "v")
    return every.join(known, ["z", "row"], "left").select("z", "row", F.coalesce("v", F.lit(0)).alias("v"))


def grey_stack(dense: DataFrame, width: int) -> DataFrame:
    """(z, y, x, v): planes of a stack (z, row, v) so that its brightest cell is 255."""
    return images.grey_planes(dense.select("z", *place(width), "v"))


def coloured_stack(dense: DataFrame, colours: DataFrame, width: int) -> DataFrame:
    """(z, y, x, r, g, b): every cell of a stack (z, row, v) in its pixel's colour (row, hue, saturation), as light as its value.

    The value that is white lies three deviations above the mean.
    """
    one = dense.agg((F.avg("v") + 3 * F.stddev_samp("v")).alias("white"))
    lit = dense.join(colours, "row", "left").join(F.broadcast(one))
    light = F.when(F.col("white") > 0, F.least(F.greatest(F.col("v") / F.col("white"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    rgb = csl_to_rgb(F.coalesce("hue", F.lit(0.0)), F.coalesce("saturation", F.lit(0.0)), light)
    return lit.select("z", *place(width), *(c.alias(n) for c, n in zip(rgb, RGB, strict=True)))


def mask_pixels(mask: DataFrame, colours: DataFrame) -> DataFrame:
    """(m, y, x, r, g, b, r0, g0, b0): pixels of masks in their mask's colour, and that colour without light."""
    known = mask.join(F.broadcast(colours), "m")
    lit, dark = csl_to_rgb(F.col("hue"), F.col("saturation"), F.col("val")), csl_to_rgb(F.col("hue"), F.col("saturation"), F.lit(0.0))
    return known.select("m", "y", "x", *(c.alias(n) for c, n in zip(lit, RGB, strict=True)), *(c.alias(f"{n}0") for c, n in zip(dark, RGB, strict=True)))


def write_cells(cells: Cells, px: DataFrame, time: int, params: SvdParams, folder: str) -> None:
    """Everything about the cells of a stack (px, t, v), below ``folder``.

    ``dims.json``; ``cell/0000`` and on with ``bb.json``, ``signal.json``, ``color.png`` and ``gray.png`` of each
    mask; and a picture per time in ``recons_c``, ``raw`` and ``raw_c``.
    """
    size = {"height": params.height, "width": params.width}
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "dims.json"), "w") as file:
        file.write(text_files.shape_json(params.width, params.height, time))
    for name, texts in (("bb", text_files.box_json(cells.masks.bbox)), ("signal", text_files.signal_json(cells.traces))):
        files = texts.select(F.format_string(f"cell/%04d/{name}.json", "m").alias("name"), F.col("json").cast("binary").alias("content"))
        images.write_files(files, folder)
    grey = cells.colours.select("m", F.lit(0.0).alias("hue"), F.lit(0.0).alias("saturation"))
    for name, colours in (("color", cells.colours), ("gray", grey)):
        drawn = images.images(mask_pixels(cells.scaled, colours), "m", channels=RGB, behind=("r0", "g0", "b0"), **size)
        images.write_images(drawn, "m", folder, f"cell/%04d/{name}.png")
    images.write_images(images.images(cells.frames, "t", channels=RGB, **size), "t", os.path.join(folder, "recons_c"))
    dense = dense_stack(px, time, params)
    images.write_images(images.images(grey_stack(dense, params.width), "z", **size), "z", os.path.join(folder, "raw"))
    coloured = coloured_stack(dense, cells.pixel_colours, params.width)
    images.write_images(images.images(coloured, "z", channels=RGB, **size), "z", os.path.join(folder, "raw_c"))
