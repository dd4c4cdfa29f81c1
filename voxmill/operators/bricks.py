"""A volume as bricks: cubes of voxels with a rim, at which points are read one by one.

A brick holds its cube's voxels and one more layer at its upper faces, so that whatever a point
needs for interpolation lies in one brick. A point travels once, to its brick; rows of a task come sorted,
a brick before its points, and one kernel reads a batch of points at once. Memory is a brick and a
batch. A brick with very many points is dealt in copies, so that its points are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import AXES

#: Voxels along the edge of a brick, without its rim.
EDGE = 16
SIDE = EDGE + 1
VOXEL = np.dtype("<u2")
CELL = [f"b{a}" for a in AXES]
#: Points of a brick from which on they are spread, and the most bricks of which that is done by broadcast.
CROWD, CROWDED_BRICKS = 200_000, 10_000


def bricks_of(voxels: DataFrame) -> DataFrame:
    """(bz, by, bx, data) of ``voxels`` (z, y, x, v): the voxels of each brick as 16-bit numbers; absent ones are 0.

    A voxel at a lower face also belongs to the rim of the brick before.
    """
    placed = voxels.select(*AXES, "v")
    for a in AXES:
        own = F.floor(F.col(a) / EDGE).cast("int")
        placed = placed.withColumn(f"b{a}", F.explode(F.when(F.col(a) % EDGE == 0, F.array(own, own - 1)).otherwise(F.array(own))))
    local = F.lit(0)
    for a in AXES:
        local = local * SIDE + (F.col(a) - F.col(f"b{a}") * EDGE)

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        data = np.zeros(SIDE**3, VOXEL)
        v = rows.column("v").to_numpy()
        if len(v) and not 0 <= v.min() <= v.max() <= 65535:
            raise ValueError("a voxel does not fit 16 bits")
        data[rows.column("at").to_numpy()] = v
        return pa.table({**{name: pa.array([part.as_py()], pa.int32()) for name, part in zip(CELL, key, strict=True)}, "data": [data.tobytes()]})

    cells = placed.where(" and ".join(f"{c} >= 0" for c in CELL)).select(*CELL, local.cast("int").alias("at"), F.col("v").cast("int").alias("v"))
    return cells.groupBy(*CELL).applyInArrow(pack, "bz int, by int, bx int, data binary")


def values_at(cube: np.ndarray, at: list[np.ndarray], part: list[np.ndarray]) -> np.ndarray:
    """Values of a brick between the voxels at local places ``at`` and the next ones, by the fractions ``part``."""
    total = np.zeros(len(at[0]))
    for corner in np.ndindex(2, 2, 2):
        weight = np.ones(len(total))
        for c, p in zip(corner, part, strict=True):
            weight *= p if c else 1 - p
        used = weight > 0  # a corner of no weight may lie beyond the volume
        place = [a[used] + c for a, c in zip(at, corner, strict=True)]
        total[used] += weight[used] * cube[place[0], place[1], place[2]]
    return total


def read_points(names: list[str]):
    """Of rows sorted by brick, a brick before its points: ``names`` and val of the points."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cube = None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in (*CELL, "copy")])
            bounds = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))) if batch.num_rows else []
            is_point = batch.column("data").is_null().to_numpy(zero_copy_only=False)
            at = [batch.column(f"l{a}").to_numpy(zero_copy_only=False) for a in AXES]
            part = [batch.column(f"t{a}").to_numpy(zero_copy_only=False) for a in AXES]
            val = np.zeros(batch.num_rows)
            for first, last in zip(bounds, [*bounds[1:], batch.num_rows], strict=True):
                key = tuple(keys[:, first])
                if key != held:
                    held, cube = key, None  # a brick that no voxel lies in stays empty
                while first < last and not is_point[first]:
                    cube = np.frombuffer(batch.column("data")[int(first)].as_py(), VOXEL).reshape(SIDE, SIDE, SIDE)
                    first += 1
                if cube is not None and first < last:
                    val[first:last] = values_at(cube, [x[first:last].astype(np.int64) for x in at], [x[first:last] for x in part])
            columns = [batch.column(n) for n in names]
            made = pa.RecordBatch.from_arrays([*columns, pa.array(val)], names=[*names, "val"])
            yield made.filter(pa.array(is_point))

    return read


def gather(points: DataFrame, bricks: DataFrame, keys: list[str], whole: dict[str, Column], part: dict[str, Column], crowd: int = CROWD) -> DataFrame:
    """``keys`` and val of ``points`` that lie in the volume: ``whole`` and ``part`` are place and fraction on each axis."""
    cells = points.select(
        *keys,
        *(F.floor(whole[a] / EDGE).cast("int").alias(f"b{a}") for a in AXES),
        *((whole[a] - F.floor(whole[a] / EDGE) * EDGE).cast("int").alias(f"l{a}") for a in AXES),
        *(part[a].cast("double").alias(f"t{a}") for a in AXES),
    )
    counts = cells.groupBy(*CELL).count()
    size = counts.agg(F.max("count"), F.sum("count")).first()
    bound = max(crowd, (size[1] or 0) // CROWDED_BRICKS)
    copies = F.lit(1)
    if (size[0] or 0) > bound:
        crowded = counts.where(F.col("count") > bound).select(*CELL, F.ceil(F.col("count") / bound).cast("int").alias("copies"))
        cells, bricks = (side.join(F.broadcast(crowded), CELL, "left") for side in (cells, bricks))  # at most CROWDED_BRICKS rows
        copies = F.coalesce("copies", F.lit(1))
    dealt = cells.select(*CELL, F.pmod(F.xxhash64(*keys), copies).cast("int").alias("copy"), F.lit(None).cast("binary").alias("data"), *keys, *(f"{k}{a}" for k in "lt" for a in AXES))
    empty = [F.lit(None).cast(points.schema[k].dataType).alias(k) for k in keys]
    places = [F.lit(0).cast("int" if k == "l" else "double").alias(f"{k}{a}") for k in "lt" for a in AXES]
    held = bricks.select(*CELL, F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), "data", *empty, *places)
    sides = held.unionByName(dealt)
    width = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*CELL, "copy", F.col("data").isNull()]
    sorted_ = sides.repartition(width, *CELL, "copy").sortWithinPartitions(*order)
    schema = ", ".join([*(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys), "val double"])
    return sorted_.mapInArrow(read_points(keys), schema)
