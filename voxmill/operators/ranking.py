"""Numbering of rows by a sort, running sums over an order, and ranks along linked lists; all over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Rounds, cut_lineage

#: Places of one bucket of a running sum.
BUCKET = 1 << 16


def numbered(rows: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """``rows`` with ``name``: their place from 0 by ``order``, without gaps.

    A sort deals rows over tasks; a task's rows follow those of the tasks before it, whose sizes are
    the only thing that is added up over tasks.
    """
    held = cut_lineage(rows.orderBy(*order))
    placed = held.withColumn("place_", F.monotonically_increasing_id()).withColumn("task_", F.spark_partition_id())
    tasks = placed.groupBy("task_").agg(F.min("place_").alias("first_"), F.count("*").alias("size_"))
    before = Window.orderBy("task_").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    shifts = tasks.select("task_", (F.coalesce(F.sum("size_").over(before), F.lit(0)) - F.col("first_")).alias("shift_"))
    met = placed.join(F.broadcast(shifts), "task_")
    return met.select(*rows.columns, (F.col("place_") + F.col("shift_")).alias(name))


def running_sums(rows: DataFrame, place: str, columns: list[str]) -> DataFrame:
    """``rows`` with each of ``columns`` replaced by its sum up to the row, in the order of ``place`` (from 0, without gaps).

    In buckets of places: sums within a bucket, and what the buckets before it sum up to.
    """
    dealt = rows.withColumn("bucket_", F.floor(F.col(place) / BUCKET))
    inside = Window.partitionBy("bucket_").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)  # one row for BUCKET rows
    totals = dealt.groupBy("bucket_").agg(*(F.sum(c).alias(c) for c in columns))
    shifts = totals.select("bucket_", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before_") for c in columns))
    met = dealt.join(shifts, "bucket_")
    return met.select(*((F.sum(c).over(inside) + F.col(f"{c}_before_")).alias(c) if c in columns else F.col(c) for c in rows.columns))


def list_ranks(links: DataFrame) -> DataFrame:
    """(id, after): how many steps ``links`` (id, next) take from each id to the end of its list, where next is null.

    By pointer doubling: a round lets every element look twice as far, so a list of a million takes about
    twenty. Each element is the next of one at most, so no key has more than one row on either side.
    """
    rounds = Rounds(links.sparkSession)
    far = rounds.next(links.select("id", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("after")))
    while not far.where("next is not null").isEmpty():
        ahead = far.select(F.col("id").alias("next"), F.col("next").alias("further"), F.col("after").alias("more"))
        stepped = far.where("next is not null").join(ahead, "next").select("id", F.col("further").alias("next"), (F.col("after") + F.col("more")).alias("after"))
        far = rounds.next(far.where("next is null").unionByName(stepped))
    return far.select("id", "after")
