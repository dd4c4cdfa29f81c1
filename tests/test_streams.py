"""Streams of draws, and the reservoir that they renew, restarts included."""

import pytest
from pyspark.sql import functions as F

from voxmill.operators import sampling
from voxmill.sources.draw_stream import DrawReader
from voxmill.streaming import heat_stream, reservoir

DEPTH, HEIGHT, WIDTH, SEED = 5, 12, 9, 42


def volume(spark):
    v = (F.col("id") * 2654435761 % 60000).cast("int")
    return spark.range(DEPTH * HEIGHT * WIDTH).select(
        F.floor(F.col("id") / (HEIGHT * WIDTH)).cast("int").alias("z"),
        F.floor(F.col("id") % (HEIGHT * WIDTH) / WIDTH).cast("int").alias("y"),
        (F.col("id") % WIDTH).cast("int").alias("x"),
        v.alias("v"),
    )


def numbers_of(reader, start, end):
    return [n for part in reader.partitions({"next": start}, {"next": end}) for batch in reader.read(part) for n in batch.column(0).to_pylist()]


def test_offsets_cover_every_number_once():
    reader = DrawReader({"perBatch": "100000", "perTask": "70000", "first": "5", "end": "170000"})
    at, seen = reader.initialOffset()["next"], []
    while (end := reader.latestOffset()["next"]) > at:
        assert reader.latestOffset() == {"next": end}  # asking does not draw
        seen += numbers_of(reader, at, end)
        at = end
    assert seen == list(range(5, 170000))
    assert numbers_of(reader, at, at) == []


def test_a_new_reader_goes_on_where_the_engine_is():
    reader = DrawReader({"perBatch": "10"})
    assert numbers_of(reader, 40, 40) == []  # what the engine plans first after a restart
    assert reader.latestOffset() == {"next": 50}
    assert numbers_of(reader, 30, 40) == list(range(30, 40))  # a batch run again
    assert reader.latestOffset() == {"next": 50}


@pytest.mark.parametrize("options", [{"perBatch": "0"}, {"perTask": "-1"}, {"first": "-3"}])
def test_bad_options_are_refused(options):
    with pytest.raises(ValueError):
        DrawReader(options)


def test_first_beyond_the_end_gives_nothing():
    reader = DrawReader({"first": "9", "end": "4"})
    assert reader.latestOffset() == reader.initialOffset()


@pytest.mark.parametrize("held", [100, 0])
def test_reservoir_equals_the_refreshed_sample_over_restarts(spark, tmp_path, held):
    """Three starts from one checkpoint, each with a batch more of an endless stream; also of an empty first sample."""
    n, per_batch = 150, 400
    voxels = volume(spark)
    first = sampling.bright_points(voxels, sampling.uniform_draws(spark, 2000, DEPTH, HEIGHT, WIDTH, 7), held)
    sample = spark.createDataFrame(first.select("idx", "z", "y", "x").collect(), "idx int, z int, y int, x int")
    path = str(tmp_path / "changes")
    reservoir.prepare(spark)
    for batches in (1, 2, 3):
        drawn = heat_stream.endless_draws(spark, DEPTH, HEIGHT, WIDTH, SEED, perBatch=per_batch, perTask=150)
        changes = reservoir.reservoir_stream(sample, sampling.accepted_draws(voxels, drawn), n, SEED)
        run = changes.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", str(tmp_path / "checkpoint"))
        run.trigger(availableNow=True).start().awaitTermination(120)
        got = reservoir.sample_after(sample, spark.read.schema(reservoir.SLOT).parquet(path))
        accepted = sampling.accepted_draws(voxels, sampling.uniform_draws(spark, batches * per_batch, DEPTH, HEIGHT, WIDTH, SEED))
        want = sampling.refreshed_sample(sample, accepted, accepted.count(), n, SEED)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("idx", "z", "y", "x").collect()))
    changed = spark.read.schema(reservoir.SLOT).parquet(path)
    assert changed.count() > changed.select("idx").distinct().count()  # slots were overwritten again


def test_a_late_draw_does_not_overwrite_a_later_one(spark, tmp_path):
    """A slot keeps the point of its highest draw, though a lower one comes in a later batch."""
    folder = str(tmp_path / "accepted")
    schema = "d long, z int, y int, x int"
    reservoir.prepare(spark)
    for number, rows in enumerate([[(8, 1, 1, 1)], [(3, 2, 2, 2), (5, 3, 3, 3)]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        accepted = spark.readStream.schema(schema).parquet(folder)
        empty = spark.createDataFrame([], "idx int, z int, y int, x int")
        changes = reservoir.reservoir_stream(empty, accepted, 1, SEED)  # one slot for all
        run = changes.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint"))
        run.trigger(availableNow=True).start().awaitTermination(120)
    assert [tuple(r) for r in spark.read.schema(reservoir.SLOT).parquet(str(tmp_path / "out")).collect()] == [(0, 8, 1, 1, 1)]
