"""Exact deduplication with a split of heavy hitters.

Every text becomes a SHA-256 digest. A Misra-Gries summary of each partition keeps a fixed number of
counters; the summed counters name the few digests that can be frequent over the whole table. Those
are counted exactly, and the winners of the ones that are frequent indeed are broadcast: their copies
are decided where they lie. All other digests are shuffled: groups are first summed up by every task
for itself, so that each sends one row, and rows then meet their group in a join that is split where
a key has many rows.

Texts are equal when they are identical; a null text counts as empty. The row with the largest
doc_id stays; a null doc_id is smaller than any other. Of rows that repeat both text and doc_id, one
stays. Texts of any length are hashed whole, and only digests are shuffled for the map. Other columns are not
read for the map and passed on by ``deduplicate``, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, joined_by_key, materialize

#: Counters of a summary. A digest in more than 2 / COUNTERS of all rows is found for certain.
COUNTERS = 1024


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))


def misra_gries(batches: Iterator[np.ndarray], counters: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of a Misra-Gries summary of fixed-width byte keys.

    A batch's exact counts are merged into the counters, then all counters lose what the largest of
    the superfluous ones has. Each count is too low by at most rows / (counters + 1).
    """
    keys, counts = None, None
    for batch in batches:
        own, times = np.unique(batch, return_counts=True)
        if keys is not None:
            both = np.concatenate((keys, own))
            own, place = np.unique(both, return_inverse=True)
            times = np.bincount(place, weights=np.concatenate((counts, times))).astype(np.int64)
        if len(own) > counters:
            times = times - np.partition(times, -counters - 1)[-counters - 1]
            own, times = own[times > 0], times[times > 0]
        keys, counts = own, times
    if keys is None:
        return np.empty(0, "S32"), np.empty(0, np.int64)
    return keys, counts


def heavy_winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """digest, keep_id and group_size of every digest in more than ``2 / counters`` of all rows.

    ``digests`` has doc_id and digest. At most ``counters`` rows come out: the broadcast has a bound.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0

        def keys() -> Iterator[np.ndarray]:
            nonlocal rows
            for batch in batches:
                rows += batch.num_rows
                if batch.num_rows:
                    yield np.frombuffer(b"".join(batch.column("digest").to_pylist()), dtype="S32")

        digest, count = misra_gries(keys(), counters)
        # numpy strips zero bytes at the end of a string
        names = [bytes(d).ljust(32, b"\0") for d in digest] + [None]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array([*count.tolist(), rows], pa.int64())], names=["digest", "counter"]
        )

    summaries = digests.select("digest").mapInArrow(summarise, "digest binary, counter long")
    summed = materialize(summaries.groupBy("digest").agg(F.sum("counter").alias("counter")))
    rows = summed.where("digest is null").agg(F.sum("counter")).first()[0] or 0
    # Counters sum to at most all rows, so no more than `counters` digests reach this bound.
    candidates = summed.where(F.col("digest").isNotNull() & (F.col("counter") > rows / counters)).select("digest")
    exact = (
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    return materialize(exact.where(F.col("group_size") > 2 * rows / counters))


def duplicate_map(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, dropped ones too."""
    digests = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"))
    digests = materialize(digests.withColumn("row", F.monotonically_increasing_id()))
    winners = heavy_winners(digests, counters)
    # Of rows that repeat the winning doc_id, the one that was numbered last stays.
    exact_row = digests.join(F.broadcast(winners), "digest").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    winners = winners.join(F.broadcast(exact_row.groupBy("digest").agg(F.max("row").alias("keep_row"))), "digest")
    split = digests.join(F.broadcast(winners), "digest", "left")
    heavy = split.where(F.col("group_size").isNotNull()).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest"
    )
    rare = split.where(F.col("group_size").isNull()).select("doc_id", "row", "digest")
    groups = rare.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size"))
    light = joined_by_key(rare, materialize(groups), "digest", "group_size").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "digest"
    )
    return heavy.unionByName(light).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Copies of frequent texts are removed before the shuffle; only their winners and the rows of rare
    texts are shuffled, once and whole.
    """
    digest, winner, rank = (fresh_name(docs, name) for name in ("digest_", "winner_", "rank_"))
    winners = heavy_winners(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest")), counters)
    winners = winners.select(F.col("digest").alias(digest), F.col("keep_id").alias(winner), F.lit(True).alias(rank))
    marked = docs.withColumn(digest, text_digest()).join(F.broadcast(winners), digest, "left")
    left = marked.where(F.col(rank).isNull() | F.col("doc_id").eqNullSafe(F.col(winner)))
    order = Window.partitionBy(digest).orderBy(F.col("doc_id").desc_nulls_last())
    return left.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
