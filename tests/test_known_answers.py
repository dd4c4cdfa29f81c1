"""Volumes, trees and matrices whose results are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.functions.geometry import AXES
from voxmill.operators import factor, graph, grow, neighbours, resample, sampling, spectrum, spline
from voxmill.params import DimensionsParams, StraightenParams
from voxmill.plans import programs
from voxmill.sources import images, raw_volume, text_files
from voxmill.streaming import heat_stream

SHAPE = resample.Shape(4, 5, 6)


def ramp(spark, shape=SHAPE):
    z, y, x = (F.col(a) for a in AXES)
    grid = spark.range(shape.depth).select(F.col("id").cast("int").alias("z"))
    for axis, size in (("y", shape.height), ("x", shape.width)):
        grid = grid.crossJoin(spark.range(size).select(F.col("id").cast("int").alias(axis)))
    return grid.withColumn("v", (10 * x + 100 * y + 1000 * z).cast("int"))


def test_trilinear_of_a_ramp_is_linear_and_zero_outside(spark):
    points = spark.createDataFrame([(0, 1.25, 2.5, 3.75), (1, 0.0, 0.0, 0.5), (2, -1.0, 2.0, 2.0), (3, 1.0, 99.0, 2.0)], "i int, z double, y double, x double")
    found = {r["i"]: r["val"] for r in resample.trilinear(points, ramp(spark), SHAPE, ["i"]).collect()}
    assert found == pytest.approx({0: 1250 + 250 + 37.5, 1: 5.0, 2: 0.0, 3: 0.0})


def test_nearest_voxel_of_a_ramp(spark):
    points = spark.createDataFrame([(0, 1.2, 2.4, 3.7), (1, 9.0, 0.0, 0.0)], "i int, z double, y double, x double")
    found = {r["i"]: r["val"] for r in resample.nearest_voxel(points, ramp(spark), SHAPE, ["i"]).collect()}
    assert found == {0: 1240.0, 1: 0.0}


@pytest.mark.parametrize("layout", ["file", "parts"])
@pytest.mark.parametrize("scheme", ["", "file://"])
def test_raw_volume_round_trip(spark, tmp_path, layout, scheme):
    path = f"{scheme}{tmp_path}/new/ramp.raw"
    for _ in range(2):  # the second overwrites
        raw_volume.write_raw(ramp(spark).repartition(5), path, SHAPE.depth, SHAPE.height, SHAPE.width, layout)
    if layout == "file":
        assert np.fromfile(tmp_path / "new" / "ramp.raw", "<u2").reshape(SHAPE.depth, SHAPE.height, SHAPE.width)[3, 4, 5] == 3450
    assert [p.name for p in (tmp_path / "new").iterdir()] == ["ramp.raw"]
    read = spark.read.format("rawvol").options(width=SHAPE.width, height=SHAPE.height, planesPerPartition=1).load(path)
    assert read.exceptAll(ramp(spark)).isEmpty() and read.count() == SHAPE.depth * SHAPE.height * SHAPE.width
    assert read.where("z = 2").count() == SHAPE.height * SHAPE.width


@pytest.mark.parametrize("layout", ["file", "parts"])
def test_a_failed_task_leaves_no_half_volume(spark, tmp_path, layout):
    bad = ramp(spark).withColumn("v", F.when(F.col("z") == 3, 70_000).otherwise(F.col("v")))
    path = tmp_path / "ramp.raw"
    with pytest.raises(Exception, match="16 bits"):
        raw_volume.write_raw(bad, str(path), SHAPE.depth, SHAPE.height, SHAPE.width, layout)
    assert list(tmp_path.iterdir()) == []
    raw_volume.write_raw(ramp(spark).where("z = 3"), str(path), SHAPE.depth, SHAPE.height, SHAPE.width, layout)  # other planes are 0
    before = raw_volume.Stored(str(path)).read(0, 2 * SHAPE.depth * SHAPE.height * SHAPE.width)
    with pytest.raises(Exception, match="16 bits"):
        raw_volume.write_raw(bad, str(path), SHAPE.depth, SHAPE.height, SHAPE.width, layout)
    assert raw_volume.Stored(str(path)).read(0, len(before)) == before and not any(before[: 2 * SHAPE.height * SHAPE.width])


@pytest.mark.parametrize("value, accepted", [(0, 0), (65535, 64)])
def test_black_is_never_sampled_and_white_nearly_always(spark, value, accepted):
    voxels = ramp(spark, resample.Shape(4, 4, 4)).withColumn("v", F.lit(value))
    assert abs(sampling.bright_sample(voxels, 42).count() - accepted) <= (1 if value else 0)


def test_periodic_series_gives_its_period(spark):
    rng = np.random.default_rng(3)
    pattern = rng.integers(0, 1000, 16)
    series = spark.createDataFrame([(i, float(pattern[i % 16])) for i in range(16 * 24)], "i long, v double")
    correlation = spectrum.autocorrelation(series, 16 * 24, 40)
    assert spectrum.top_lags(correlation, 1).first()[0] % 16 == 0


def test_tree_of_a_line_and_ties(spark):
    rows = [(i, 0.0, 0.0, float(i)) for i in range(6)]
    points = spark.createDataFrame(rows, "idx int, z double, y double, x double")
    edges = graph.minimum_spanning_tree(points)
    assert {(r["u"], r["w"]) for r in edges.collect()} == {(i, i + 1) for i in range(5)}
    line = [r["x"] for r in graph.backbone(spark, points).orderBy("idx").collect()]
    assert line in ([0, 1, 2, 3, 4, 5], [5, 4, 3, 2, 1, 0])
    by_joins = graph.boruvka(graph.pairwise_distances(points).where("u < w"))
    assert by_joins.agg(F.sum("d")).first()[0] == pytest.approx(5.0)


def test_nearest_by_grid_is_nearest(spark):
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 50, (80, 3)))], "d int, z double, y double, x double")
    controls = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 50, (9, 3)))], "idx int, z double, y double, x double")
    a, b = neighbours.nearest(points, controls), neighbours.nearest_by_grid(points, controls)
    assert {(r["d"], r["nn"]) for r in a.collect()} == {(r["d"], r["nn"]) for r in b.collect()}


def test_flood_takes_four_neighbours_only(spark):
    cells = [(0, 0), (0, 1), (1, 1), (2, 2)]
    pixels = spark.createDataFrame([(y, x, 1 if (y, x) in cells else 0) for y in range(4) for x in range(4)], "y int, x int, v int")
    seeds = spark.createDataFrame([(0, 0)], "y int, x int")
    assert {(r["y"], r["x"]) for r in grow.flood(pixels, seeds, F.col("v") == 1).collect()} == {(0, 0), (0, 1), (1, 1)}


def test_rank_two_matrix_has_two_singular_values(spark):
    rng = np.random.default_rng(7)
    matrix = np.outer(rng.uniform(1, 9, 30), rng.uniform(1, 9, 8)) + np.outer(rng.uniform(1, 9, 30), rng.uniform(1, 9, 8))
    px = spark.createDataFrame([(i, t, float(matrix[i, t])) for i in range(30) for t in range(8)], "px int, t int, v double")
    svd = factor.truncated_svd(px, 8, 4)
    values = sorted((r["val"] for r in svd.s.collect()), reverse=True)
    assert values[:2] == pytest.approx(np.linalg.svd(matrix)[1][:2], rel=1e-6)
    assert all(v < 1e-3 * values[0] for v in values[2:])


def test_spline_goes_through_its_points():
    points = np.array([[0, 0, 0], [1, 2, 1], [2, 3, 4], [5, 3, 6]], dtype=float)
    chords = np.sqrt((np.diff(points, axis=0) ** 2).sum(axis=1))
    assert spline.natural_spline(points).length == pytest.approx(chords.sum())


def test_straightened_stripe_keeps_its_brightness(spark):
    shape = resample.Shape(9, 40, 12)
    z, y, x = (F.col(a) for a in AXES)
    voxels = ramp(spark, shape).withColumn("v", F.when((z == 4) & (x == 6), 60000).otherwise(0).cast("int"))
    line = np.array([[4.0, float(v), 6.0] for v in range(4, 36, 4)])
    result = programs.straighten(spark, voxels, shape, StraightenParams(out_width=4, out_extra=0), controls=line)
    bright = result.volume.where("v = 60000")
    assert bright.select("y").distinct().count() == result.shape.height  # in every row of the output
    assert bright.select("z", "x").distinct().count() == 1  # and always in its middle


def test_controls_are_read_as_written(spark, tmp_path):
    controls = spark.createDataFrame([(0, 0.5, 1.5, 2.5), (1, 2.0, 4.0, 5.0)], "idx int, z double, y double, x double")
    text_files.write_controls(controls, str(tmp_path / "line"))
    assert {tuple(r) for r in text_files.read_controls(spark, str(tmp_path / "line")).select("idx", *AXES).collect()} == {tuple(r) for r in controls.collect()}


@pytest.mark.parametrize("dtype, channels", [(np.uint8, 1), (np.uint8, 3), (np.uint16, 1)])
def test_png_signature_and_size(dtype, channels):
    pixels = np.zeros((3, 5, channels) if channels > 1 else (3, 5), dtype=dtype)
    data = images.encode_png(pixels)
    assert data.startswith(b"\x89PNG\r\n\x1a\n") and data[16:24] == (5).to_bytes(4, "big") + (3).to_bytes(4, "big")


def test_heat_of_a_stream_equals_heat_of_the_batch(spark, tmp_path):
    voxels = ramp(spark)
    folder = str(tmp_path / "draws")
    spark.range(300).select(F.col("id").alias("value")).repartition(3).write.parquet(folder)
    stream = spark.readStream.schema("value long").option("maxFilesPerTrigger", 1).parquet(folder)
    draws = heat_stream.draws_of(stream, SHAPE.depth, SHAPE.height, SHAPE.width, 42)
    query = heat_stream.heat_stream(draws, voxels, 2.0, SHAPE.height).writeStream.format("memory").queryName("heat").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = heat_stream.heat_stream(heat_stream.draws_of(spark.read.parquet(folder), SHAPE.depth, SHAPE.height, SHAPE.width, 42), voxels, 2.0, SHAPE.height)
    assert {tuple(r) for r in spark.table("heat").collect()} == {tuple(r) for r in batch.collect()}


def test_bad_parameters_are_refused():
    with pytest.raises(ValueError):
        StraightenParams(mst_points=1)
    with pytest.raises(ValueError):
        DimensionsParams(max_dim=0)
