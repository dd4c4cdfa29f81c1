"""Region growing: one flood, and many masks with ownership."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import hash16, hash32
from ..params import SvdParams
from .regions import reached
from .sampling import seed_pixels
from .store import cut_lineage

#: Seeds whose masks are grown in one pass, and those drawn for each mask that is asked for, to begin with.
BATCH, SEEDS_PER_MASK = 16, 16
#: Draws after which a search for seeds is given up.
MAX_DRAWS = 1 << 26
#: Peak below which a mask is given up.
LEAST_PEAK = 0.01


def flood(pixels: DataFrame, seeds: DataFrame, accept: Column) -> DataFrame:
    """(y, x): accepted ``pixels`` that four-neighbour steps over accepted pixels reach from ``seeds`` (y, x).

    A seed itself is in only if it is accepted and has an accepted neighbour.
    """
    plane = F.lit(0).alias("m")
    return reached(pixels.where(accept).select(plane, "y", "x"), seeds.select(plane, "y", "x")).select("y", "x")


@dataclass(frozen=True)
class Masks:
    """mask (m, y, x, val), bbox (m, xmin, xmax, ymin, ymax), seed (m, row), and how many masks could be grown."""

    mask: DataFrame
    bbox: DataFrame
    seed: DataFrame
    grown: int


def loadings(u: DataFrame, parts: int) -> DataFrame:
    """(px, load, mean_loading): components 1 to ``parts`` of each row of ``u`` (row, k, val) as an array, absent ones as 0."""
    cells = u.where(F.col("k").between(1, parts)).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("k", "val"))).alias("cells"))
    load = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda k: F.coalesce(F.element_at("cells", k), F.lit(0.0)))
    rows = cells.select(F.col("row").alias("px"), load.alias("load"))
    return rows.withColumn("mean_loading", F.aggregate("load", F.lit(0.0), lambda a, x: a + x) / parts)


def seed_draws(spark: SparkSession, n: int, pixels: int, seed: int) -> DataFrame:
    """(d, px, u): ``n`` uniform pixels, each with a threshold from 0..65535."""
    d = F.col("id")
    return spark.range(n).select(d.alias("d"), (hash32(seed, 5, d) % pixels).alias("px"), hash16(seed, 6, d).alias("u"))


def grow_masks(spark: SparkSession, u: DataFrame, params: SvdParams) -> Masks:
    """Masks from seeds whose components 1 .. colors - 1 resemble the pixels around them.

    A seed is the next draw whose pixel belongs to no mask and has a mean loading above the draw's
    threshold. A mask may take pixels of earlier ones, which keep them too; a mask whose peak stays below
    LEAST_PEAK is given up, and its number tried again, at most ``max_retries`` times over all masks.
    What a seed's mask would be does not depend on the other masks, so BATCH seeds are grown in a pass; which of
    them count follows from whether an earlier one took their pixel. Masks and owned pixels are
    tables; the driver sees a few numbers of each seed. A row outside the plane is refused, and so is
    a plane where MAX_DRAWS draws give too few seeds.
    """
    pixels, parts = params.width * params.height, params.colors - 1
    held = cut_lineage(loadings(u, parts))
    last = held.agg(F.max("px")).first()[0]
    if last is not None and last >= pixels:
        raise ValueError(f"row {last} lies outside a plane of {params.width} x {params.height}")
    owned = spark.createDataFrame([], "px long")
    masks: list[DataFrame] = []
    boxes: list[tuple] = []
    seeds: list[tuple] = []
    tried, draws, retries = 0, 4096, 0
    while len(seeds) < params.masks and retries <= params.max_retries:
        free = spark.createDataFrame([], "px long")  # ownership is asked of every batch
        found = seed_pixels(held, seed_draws(spark, draws, pixels, params.seed), free, params.scale, tried + SEEDS_PER_MASK * params.masks)
        rows = found.join(held, "px").orderBy("d").select("px", "load").collect()  # a bounded number of seeds
        if len(rows) <= tried:
            if draws > MAX_DRAWS:
                raise ValueError(f"{draws} draws gave seeds for {len(seeds)} of {params.masks} masks")
            draws *= 4
            continue
        batch = rows[tried : tried + BATCH]
        tried += len(batch)
        grown, facts, taken, gone = grown_from(held, [r["load"] for r in batch], [r["px"] for r in batch], owned, params)
        numbers: dict[int, int] = {}
        done: list[int] = []
        for j, row in enumerate(batch):
            if row["px"] in gone or any(i in taken.get(row["px"], ()) for i in done):
                continue
            if len(seeds) == params.masks or retries > params.max_retries:
                break
            done.append(j)
            peak, *box = facts.get(j, (0.0,))
            if peak < LEAST_PEAK:
                retries += 1
                continue
            numbers[j] = len(seeds)
            boxes.append((len(seeds), *box))
            seeds.append((len(seeds), row["px"]))
        owned = cut_lineage(owned.unionByName(grown.where(F.col("j").isin(done)).select("px")).distinct())
        if numbers:
            named = F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair))
            masks.append(grown.where(F.col("j").isin(list(numbers))).select(named[F.col("j")].alias("m"), "y", "x", "val"))
    none = spark.createDataFrame([], "m int, y int, x int, val double")
    return Masks(
        reduce(DataFrame.unionByName, masks, none),
        spark.createDataFrame(boxes, "m int, xmin int, xmax int, ymin int, ymax int"),
        spark.createDataFrame(seeds, "m int, row long"),
        len(seeds),
    )


def grown_from(held: DataFrame, loads: list[list[float]], at: list[int], owned: DataFrame, params: SvdParams) -> tuple[DataFrame, dict, dict, set]:
    """What each of a batch of seeds would take: (grown (j, px, y, x, val), facts, taken, gone).

    facts has peak, xmin, xmax, ymin, ymax of each seed j that takes any pixel, taken the seeds that take
    a seed's pixel, and gone the seeds' pixels that are owned already.
    """
    alike = resembling(held, loads, params)
    place = [F.floor(F.col("px") / params.width).cast("int").alias("y"), (F.col("px") % params.width).cast("int").alias("x")]
    accepted = cut_lineage(alike.select("j", "px", *place, "likeness"))
    seeds = held.sparkSession.createDataFrame([(j, px) for j, px in enumerate(at)], "j int, px long")
    inside = reached(accepted.select(F.col("j").alias("m"), "y", "x"), seeds.select(F.col("j").alias("m"), *place))
    val = F.least(F.greatest(F.col("likeness") / params.colors, F.lit(0.0)), F.lit(1.0)).alias("val")
    grown = cut_lineage(accepted.join(inside.withColumnRenamed("m", "j"), ["j", "y", "x"]).select("j", "px", "y", "x", val))
    box = [f(c) for c in ("x", "y") for f in (F.min, F.max)]
    facts = {r[0]: tuple(r)[1:] for r in grown.groupBy("j").agg(F.max("val"), *box).collect()}
    pixels = F.broadcast(seeds.select("px").distinct())
    taken: dict[int, set[int]] = {}
    for row in grown.join(pixels, "px").select("px", "j").collect():
        taken.setdefault(row["px"], set()).add(row["j"])
    return grown, facts, taken, {r["px"] for r in owned.join(pixels, "px").collect()}


def resembling(held: DataFrame, loads: list[list[float]], params: SvdParams) -> DataFrame:
    """(j, px, likeness) of the pixels of ``held`` (px, load) that resemble the j-th of ``loads``."""
    seeds = np.array(loads, dtype=float)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("load").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            likeness = own @ seeds.T * params.scale**2
            row, j = np.nonzero(likeness > params.threshold)
            px = batch.column("px").to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(px, pa.int64()), pa.array(likeness[row, j])], names=["j", "px", "likeness"])

    return held.select("px", "load").mapInArrow(compare, "j int, px long, likeness double")


def bounding_boxes(mask: DataFrame) -> DataFrame:
    return mask.groupBy("m").agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))
