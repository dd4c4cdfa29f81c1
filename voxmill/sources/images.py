"""PNG images from tables of pixels, encoded where the pixels are."""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: its signature, and the colour type for each number of channels.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
COLOUR_TYPE = {1: 0, 2: 4, 3: 2, 4: 6}


def encode_png(pixels: np.ndarray) -> bytes:
    """``pixels`` (height x width, or x channels; 8 or 16 bit) as a PNG file: grey or RGB, with or without alpha."""
    image = pixels if pixels.ndim == 3 else pixels[:, :, None]
    height, width, channels = image.shape
    depth = 16 if image.dtype.itemsize == 2 else 8
    big = image.astype(">u2" if depth == 16 else "u1")
    rows = np.zeros((height, 1 + width * channels * depth // 8), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(big.tobytes(), dtype=np.uint8).reshape(height, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, height, depth, COLOUR_TYPE[channels], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def images(pixels: DataFrame, key: str, height: int, width: int, channels: tuple[str, ...] = ("v",), behind: tuple[str, ...] = ()) -> DataFrame:
    """(key, png): one image per value of ``key`` from (key, y, x, channels...) of 0..255.

    Missing pixels are 0, or what the columns ``behind`` say in any row of the image.
    """

    def draw(of, frame):
        image = np.zeros((height, width, len(channels)), dtype=np.uint8)
        if behind:
            image[:] = frame[list(behind)].iloc[0].to_numpy()
        image[frame["y"], frame["x"]] = np.clip(frame[list(channels)].to_numpy(), 0, 255)
        return pd.DataFrame({key: [of[0]], "png": [encode_png(image)]})

    return pixels.groupBy(key).applyInPandas(draw, f"{key} int, png binary")


def grey_planes(voxels: DataFrame) -> DataFrame:
    """(z, y, x, v) scaled so that the brightest voxel is 255."""
    one = voxels.agg(F.max("v").alias("most"))
    shade = F.when(F.col("most") > 0, F.floor(F.col("v") * 255.0 / F.col("most"))).otherwise(0)
    return voxels.join(F.broadcast(one)).select("z", "y", "x", shade.cast("int").alias("v"))


def write_files(files: DataFrame, folder: str) -> None:
    """Write each row of (name, content) to its own file below ``folder``, which driver and executors share.

    A file appears under its name only when it is whole, so a task that is run again does no harm.
    """
    os.makedirs(folder, exist_ok=True)

    def put(frames):
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                path = os.path.join(folder, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "wb") as file:
                    file.write(content)
                os.replace(part, path)
            yield frame[["name"]]

    files.select("name", "content").mapInPandas(put, "name string").write.format("noop").mode("overwrite").save()


def write_images(pictures: DataFrame, key: str, folder: str, name: str = "%04d.png") -> None:
    """Write each image of (key, png) to ``folder``."""
    write_files(pictures.select(F.format_string(name, key).alias("name"), F.col("png").alias("content")), folder)
