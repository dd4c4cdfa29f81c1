"""Bricks, transforms in bands, labelled regions and draws in proportion to brightness, against plain arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.operators import bricks, regions, resample, sampling, spectrum

KEYS = ["d", "name"]


def cube_of(spark, cube):
    z, y, x = np.indices(cube.shape).reshape(3, -1).tolist()
    return spark.createDataFrame(list(zip(z, y, x, cube.reshape(-1).tolist())), "z int, y int, x int, v int")


def between(cube, point):
    """The trilinear value at a point, 0 outside."""
    low = [int(np.floor(c)) for c in point]
    if any(i < 0 or i >= max(n - 1, 1) for i, n in zip(low, cube.shape)):
        return 0.0
    total = 0.0
    for corner in np.ndindex(*(min(n, 2) for n in cube.shape)):
        weight = np.prod([1 if n == 1 else (c - i if k else 1 - (c - i)) for c, i, k, n in zip(point, low, corner, cube.shape)])
        total += weight * cube[tuple(i + k for i, k in zip(low, corner))]
    return total


@pytest.mark.parametrize("shape, crowd", [((20, 33, 18), bricks.CROWD), ((20, 33, 18), 7), ((1, 40, 17), 7)])
def test_points_between_voxels(spark, shape, crowd, monkeypatch):
    monkeypatch.setattr(bricks.gather, "__defaults__", (crowd,))
    rng = np.random.default_rng(2)
    cube = rng.integers(0, 65536, shape)
    places = rng.uniform(-2, 36, (300, 3))
    places[:40] = np.floor(places[:40])  # on voxels, faces of bricks and the volume's ends
    places[40:80] = places[40]  # many points in one brick
    if shape[0] == 1:
        places[:, 0] = rng.uniform(0, 1.2, 300)
    points = spark.createDataFrame([(i, f"p{i}", *map(float, p)) for i, p in enumerate(places)], "d int, name string, z double, y double, x double").repartition(4)
    voxels, volume = cube_of(spark, cube), resample.Shape(*shape)
    found = {r["d"]: (r["name"], r["val"]) for r in resample.trilinear(points, voxels, volume, KEYS).collect()}
    assert found == {i: (f"p{i}", pytest.approx(between(cube, p), abs=1e-6)) for i, p in enumerate(places)}
    nearest = {r["d"]: r["val"] for r in resample.nearest_voxel(points, voxels, volume, KEYS).collect()}
    for i, p in enumerate(places):
        at = np.rint(p).astype(int)
        assert nearest[i] == (cube[tuple(at)] if all(0 <= a < n for a, n in zip(at, shape)) else 0)


def test_a_ramp_of_64_cubed_is_linear(spark):
    voxels = spark.range(64**3).select(
        F.floor(F.col("id") / 4096).cast("int").alias("z"), (F.floor(F.col("id") / 64) % 64).cast("int").alias("y"), (F.col("id") % 64).cast("int").alias("x")
    ).withColumn("v", 10 * F.col("x") + 100 * F.col("y") + 700 * F.col("z"))
    part = lambda i: F.pmod(F.xxhash64("d", F.lit(i)), F.lit(62_999)) / 1000.0
    points = spark.range(20_000).withColumnRenamed("id", "d").select("d", part(0).alias("z"), part(1).alias("y"), part(2).alias("x"))
    found = resample.trilinear(points, voxels, resample.Shape(64, 64, 64), ["d"]).join(points, "d")
    off = found.agg(F.count("*"), F.max(F.abs(F.col("val") - 10 * F.col("x") - 100 * F.col("y") - 700 * F.col("z")))).first()
    assert off[0] == 20_000 and off[1] < 1e-6


def test_a_point_without_a_brick_is_dark(spark):
    voxels = spark.createDataFrame([(0, 0, 0, 9)], "z int, y int, x int, v int")
    points = spark.createDataFrame([(1, "a", 40.5, 40.5, 40.5), (2, "b", 0.0, 0.0, 0.0), (3, "c", None, 1.0, 1.0)], "d int, name string, z double, y double, x double")
    found = {r["d"]: r["val"] for r in resample.trilinear(points, voxels, resample.Shape(64, 64, 64), KEYS).collect()}
    assert found == {1: 0.0, 2: 9.0, 3: 0.0}


@pytest.mark.parametrize("n, top, band", [(2, 1, 1 << 16), (3, 2, 1 << 16), (97, 96, 8), (1000, 50, 64), (20_011, 20_010, 1 << 10)])
@pytest.mark.parametrize("center", [False, True])
def test_correlations_in_bands_are_those_of_one_transform(spark, monkeypatch, n, top, band, center):
    monkeypatch.setattr(spectrum, "BAND", band)
    values = np.random.default_rng(n).random(n) * 490
    series = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(n, 9.0), (-1, 9.0)], "i long, v double").repartition(3)
    found = spectrum.autocorrelation(series, n, top, center).orderBy("lag").collect()
    own = values - values.mean() if center else values
    expected = np.fft.irfft(np.abs(np.fft.rfft(own)) ** 2, n)[1 : top + 1]
    assert [r["lag"] for r in found] == list(range(1, top + 1))
    assert np.abs(np.array([r["r"] for r in found]) - expected).max() <= 1e-9 * max(1, np.abs(expected).max())


def slow_regions(pixels, seeds):
    taken = set()
    for m, y, x in seeds:
        front = [(m, y, x)]
        while front:
            m, y, x = front.pop()
            for step in ((m, y, x + 1), (m, y, x - 1), (m, y + 1, x), (m, y - 1, x)):
                if step in pixels and step not in taken:
                    taken.add(step)
                    front.append(step)
    return taken


def test_regions_over_many_tiles_are_the_slow_ones(spark):
    rng = np.random.default_rng(6)
    side = 150
    noise = {(m, int(y), int(x)) for m in range(2) for y, x in rng.integers(-20, side, (9000, 2))}
    spiral = {(2, y, x) for y in range(0, side, 2) for x in range(side)} | {(2, y, side - 1 if y % 4 == 1 else 0) for y in range(1, side, 2)}
    pixels, seeds = noise | spiral, [(0, 70, 70), (1, 3, 64), (1, 100, 100), (2, 0, 0), (0, 900, 900)]
    table = spark.createDataFrame(sorted(pixels), "m int, y int, x int").repartition(4)
    found = {tuple(r) for r in regions.reached(table, spark.createDataFrame(seeds, "m int, y int, x int")).collect()}
    assert found == slow_regions(pixels, seeds)
    assert regions.reached(table.limit(0), spark.createDataFrame(seeds, "m int, y int, x int")).count() == 0


def test_every_draw_of_a_dark_volume_is_a_point(spark):
    voxels = spark.createDataFrame([(3, 5, 2, 1), (3, 5, 9, 3), (8, 0, 0, 4), (9, 9, 9, 0)], "z int, y int, x int, v int")
    index = sampling.BrightnessIndex(voxels)
    rows = index.draws(0, 4000, 42).collect()
    assert sorted(r["d"] for r in rows) == list(range(4000))
    counts = {}
    for r in rows:
        counts[r["z"], r["y"], r["x"], r["v"]] = counts.get((r["z"], r["y"], r["x"], r["v"]), 0) + 1
    assert set(counts) == {(3, 5, 2, 1), (3, 5, 9, 3), (8, 0, 0, 4)}
    assert all(abs(n - 500 * place[3]) < 150 for place, n in counts.items())
    later = {tuple(r) for r in index.draws(100, 120, 42).collect()}
    assert later == {tuple(r) for r in rows if 100 <= r["d"] < 120}  # any range of draws on its own
    with pytest.raises(ValueError, match="dark"):
        sampling.BrightnessIndex(voxels.where("v = 0")).draws(0, 3, 42)
