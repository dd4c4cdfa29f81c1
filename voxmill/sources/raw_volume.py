"""A data source for headerless volumes of unsigned 16-bit voxels, plane after plane, row after row.

    register(spark)
    spark.read.format("rawvol").options(width=2437, height=1851).load(path)
    pieces.write.format("rawvol").option("size", bytes).mode("overwrite").save(path)

One partition reads a range of planes by seeking in the file; a filter on z leaves out the planes
it does not want. Written are pieces (at, data) of a file of ``size`` bytes. The file appears under its
name when all tasks are done, and not at all if one fails. Paths are those of any file system that pyarrow
opens: on a file system that every machine mounts, tasks write into one file; on others, or with
``layout=parts``, each task writes a part, and a list of them makes the folder a volume, which is read alike.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

SCHEMA = "z int, y int, x int, v int"
VOXEL = np.dtype("<u2")
#: Name of the list of parts of a volume that is a folder.
PARTS_LIST = "_parts.json"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


class Stored:
    """The bytes of a volume that is a file, or a folder of parts with a list of them; what no part has is 0."""

    def __init__(self, path: str):
        self.system, self.path = file_system(path)
        self.parts, self.size = None, self.system.get_file_info(self.path).size
        if self.system.get_file_info(f"{self.path}/{PARTS_LIST}").type == fs.FileType.File:
            with self.system.open_input_stream(f"{self.path}/{PARTS_LIST}") as file:
                listed = json.loads(file.read())
            self.parts, self.size = listed["parts"], listed["size"]
        elif self.size is None:
            raise FileNotFoundError(path)

    def read(self, first: int, length: int) -> bytes:
        if self.parts is None:
            with self.system.open_input_file(self.path) as file:
                return file.read_at(length, first)
        data = bytearray(length)
        for at, many, name, offset in self.parts:
            low, high = max(at, first), min(at + many, first + length)
            if low < high:
                with self.system.open_input_file(f"{self.path}/{name}") as file:
                    data[low - first : high - first] = file.read_at(high - low, offset + low - at)
        return bytes(data)


class Planes(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class RawVolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawvol"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RawVolumeReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RawVolumeWriter(self.options)


class RawVolumeReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.width, self.height = int(options["width"]), int(options["height"])
        self.planes_per_part = int(options.get("planesPerPartition", "8"))
        if self.width <= 0 or self.height <= 0:
            raise ValueError("width and height must be positive")
        self.low, self.high = 0, self.depth() - 1

    def depth(self) -> int:
        return Stored(self.path).size // (self.width * self.height * VOXEL.itemsize)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("z",):
                yield f
            elif isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            elif isinstance(f, GreaterThan):
                self.low = max(self.low, f.value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, f.value)
            elif isinstance(f, LessThan):
                self.high = min(self.high, f.value - 1)
            elif isinstance(f, LessThanOrEqual):
                self.high = min(self.high, f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        step = self.planes_per_part
        return [Planes(z, min(z + step - 1, self.high)) for z in range(self.low, self.high + 1, step)]

    def read(self, partition: Planes) -> Iterator[pa.RecordBatch]:
        cells = self.width * self.height
        y, x = np.divmod(np.arange(cells, dtype=np.int32), self.width)
        stored, size = Stored(self.path), cells * VOXEL.itemsize
        for z in range(partition.first, partition.last + 1):
            v = np.frombuffer(stored.read(z * size, size), dtype=VOXEL).astype(np.int32)
            columns = [np.full(cells, z, dtype=np.int32), y, x.astype(np.int32), v]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], names=["z", "y", "x", "v"])


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: [at, length, part, offset in the part] of each piece."""

    pieces: list


class RawVolumeWriter(DataSourceArrowWriter):
    """Writes pieces (at, data) under another name, which commit() changes and abort() removes."""

    def __init__(self, options):
        self.path, self.size = options["path"], int(options["size"])
        self.system, self.place = file_system(self.path)
        self.in_place = isinstance(self.system, fs.LocalFileSystem) and options.get("layout", "file") == "file"
        self.draft = f"{self.place}.draft-{uuid.uuid4().hex}"
        self.system.create_dir(os.path.dirname(self.place), recursive=True)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "system"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.system = file_system(self.path)[0]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        pieces = ((at, data) for batch in iterator for at, data in zip(batch.column("at").to_pylist(), batch.column("data").to_pylist(), strict=True))
        if self.in_place:
            file = os.open(self.draft, os.O_CREAT | os.O_RDWR, 0o644)
            try:
                for at, data in pieces:  # a task that is run again writes the same bytes to the same places
                    os.pwrite(file, data, at)
            finally:
                os.close(file)
            return Written([])
        task = TaskContext.get()
        name = f"part-{task.partitionId()}-{task.taskAttemptId()}"
        self.system.create_dir(self.draft, recursive=True)
        listed, offset = [], 0
        with self.system.open_output_stream(f"{self.draft}/{name}") as file:
            for at, data in pieces:
                file.write(data)
                listed.append([at, len(data), name, offset])
                offset += len(data)
        return Written(listed)

    def commit(self, messages: list) -> None:
        if self.in_place:
            with open(self.draft, "ab") as file:  # no piece, no draft yet
                file.truncate(self.size)
        else:
            self.system.create_dir(self.draft, recursive=True)
            parts = sorted(piece for m in messages if m is not None for piece in m.pieces)
            with self.system.open_output_stream(f"{self.draft}/{PARTS_LIST}") as file:
                file.write(json.dumps({"size": self.size, "parts": parts}).encode())
        if not self.in_place or self.system.get_file_info(self.place).type == fs.FileType.Directory:
            self.drop(self.place)  # else the move puts one file in the place of another
        self.system.move(self.draft, self.place)

    def abort(self, messages: list) -> None:
        self.drop(self.draft)

    def drop(self, path: str) -> None:
        kind = self.system.get_file_info(path).type
        if kind == fs.FileType.Directory:
            self.system.delete_dir(path)
        elif kind == fs.FileType.File:
            self.system.delete_file(path)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawVolumeSource)


def as_planes(voxels: DataFrame, height: int, width: int) -> DataFrame:
    """(z, height, width, data): one binary value per plane; missing voxels are 0, others must fit 16 bits."""

    def pack(key, frame):
        import pandas as pd

        if len(frame) and not frame["v"].between(0, 65535).all():
            raise ValueError("a voxel does not fit 16 bits")
        data = np.zeros(height * width, dtype=VOXEL)
        data[frame["y"].to_numpy() * width + frame["x"].to_numpy()] = frame["v"].to_numpy()
        return pd.DataFrame({"z": [key[0]], "height": [height], "width": [width], "data": [data.tobytes()]})

    return voxels.groupBy("z").applyInPandas(pack, "z int, height int, width int, data binary")


def write_pieces(pieces: DataFrame, path: str, size: int, layout: str = "file") -> None:
    """Write a file of ``size`` bytes from (at, data); what no piece has is 0."""
    register(pieces.sparkSession)
    pieces.select(F.col("at").cast("long").alias("at"), "data").write.format("rawvol").options(size=size, layout=layout).mode("overwrite").save(path)


def write_raw(voxels: DataFrame, path: str, depth: int, height: int, width: int, layout: str = "file") -> None:
    """Write a volume (z, y, x, v); missing voxels are 0."""
    size = height * width * VOXEL.itemsize
    planes = as_planes(voxels.where(F.col("z").between(0, depth - 1)), height, width)
    write_pieces(planes.select((F.col("z").cast("long") * size).alias("at"), "data"), path, depth * size, layout)


def write_rgb(pixels: DataFrame, path: str, height: int, width: int) -> None:
    """Write one plane (y, x, r, g, b) as three bytes a pixel, row after row; missing pixels are 0."""

    def pack(key, frame):
        import pandas as pd

        line = np.zeros((width, 3), dtype=np.uint8)
        line[frame["x"].to_numpy()] = frame[["r", "g", "b"]].to_numpy()
        return pd.DataFrame({"at": [int(key[0]) * width * 3], "data": [line.tobytes()]})

    write_pieces(pixels.groupBy("y").applyInPandas(pack, "at long, data binary"), path, height * width * 3)
