"""Volumes, stacks and series derived from the generated tables, for queries and tests.

Each fixture is a statement that Spark and other SQL engines run alike; ``{dir}`` tables are read
from Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = HEIGHT = 16
DEPTH = 7
STACK_WIDTH = 15
DAYS = 30
SEED = 42
DRAWS = 2000
POINTS = 24

VOX_SQL = """select cast(l_linenumber - 1 as int) z, cast(l_suppkey % 16 as int) y, cast(l_partkey % 16 as int) x,
    cast(sum(cast(l_quantity as bigint)) * 16 % 65536 as int) v from lineitem group by 1, 2, 3"""
STACK_SQL = """select cast(user_id as int) px, cast(extract(day from ts) - 1 as int) t,
    cast(round(sum(value)) as bigint) v from events group by 1, 2"""
CONTROLS = [(0, 0.5, 1.5, 2.5), (1, 2.0, 4.0, 5.0), (2, 3.5, 8.0, 8.5), (3, 5.0, 12.0, 10.0), (4, 6.0, 14.0, 14.0)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """voxel(z, y, x, v), 7 x 16 x 16."""
    items = read(spark, sf_dir, "lineitem")
    total = F.sum(F.col("l_quantity").cast("long")) * 16 % 65536
    return items.groupBy(
        (F.col("l_linenumber") - 1).cast("int").alias("z"),
        (F.col("l_suppkey") % 16).cast("int").alias("y"),
        (F.col("l_partkey") % 16).cast("int").alias("x"),
    ).agg(total.cast("int").alias("v"))


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px(px, t, v): sparse pixels x 30 days; a missing cell is 0.

    Values of a cell are added one by one in the order of their ids: a sum of doubles near a half depends
    on its order, and would round one way or the other as the table is split.
    """
    values = read(spark, sf_dir, "events").select(
        F.col("user_id").cast("int").alias("px"), (F.dayofmonth("ts") - 1).cast("int").alias("t"), "event_id", "value"
    )
    order = Window.partitionBy("px", "t").orderBy("event_id")
    total = F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0))
    added = values.select("px", "t", F.round(total).cast("long").alias("v"), F.lead(F.lit(1)).over(order).alias("more"))
    return added.where("more is null").drop("more")


def series(spark: SparkSession, sf_dir: str, period: int = 0) -> DataFrame:
    """(i, v): all values by id, with 400 added at every ``period``-th."""
    value = F.col("value")
    if period:
        value = value + F.when(F.col("event_id") % period == 0, 400).otherwise(0)
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("i"), value.alias("v"))


def controls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTROLS, "idx int, z double, y double, x double")
