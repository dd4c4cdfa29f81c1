"""Near-duplicates by SimHash fingerprints, joined over deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments. If two fingerprints differ in three bits at most,
one of their segments differs in one bit at most; clearing that bit in both makes the segments equal.
So each distinct fingerprint is indexed under the 64 variants of its segments with one bit cleared,
one shuffle of the variants brings every pair that can link together, and the whole fingerprints verify
it. Links are made between distinct fingerprints, never between copies.

Variants that many fingerprints share are not compared pair by pair. Every fingerprint in such a
bucket is instead listed at all points within two bits of it, and at those within one bit: if x lies
within one bit of a point and y within two, x and y differ in three bits at most, and each link of
three bits or fewer has such a point. So all fingerprints that meet in a point are linked to one of
them, exactly and with a number of rows in proportion to the fingerprints.

Empty texts and nulls have fingerprint zero and are linked like any other. A row with a null doc_id
belongs to its class but never names it. Texts of any length are fingerprinted whole, in parts. Repeated
rows are in one class; extra columns are passed on by ``keep_one_of_each`` and else not read, whatever
their names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, joined_by_key, materialize, shuffle_width
from .components import connected_components

#: Fixed value of the fingerprint: the seed of its hash.
SEED = 42
MAX_BITS = 3
#: Larger buckets take the path that does not compare pairs.
PAIRED_BUCKET = 256


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of all ``width``-word shingles of a text, A-Z in lower case, repeats included."""
    words = text.encode("utf-8", "replace").lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[width - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last, strict=False)], dtype=np.uint64)


def fingerprint(text: str, width: int = 3) -> int:
    """The SimHash of a text: a bit is set if more than half of its shingles' hashes have it."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash of the hashes of a text's shingles."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 65_536):
        octets = hashes[part : part + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py() or "", width) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(values.view(np.int64))], names=["doc_id", "text_key", "fp"]
            )

    columns = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text")
    )
    return columns.mapInArrow(run, "doc_id long, text_key long, fp long")


def deletion_variants(points: DataFrame) -> DataFrame:
    """fp and key: the number of the cleared bit, and the segment without it."""
    bit = F.col("bit")
    segment = F.when(bit < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    cleared = segment.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit % 32)")))
    every = points.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    return every.select("fp", (F.shiftleft(bit.cast("long"), 32)).bitwiseOR(cleared).alias("key"))


def spanning_links(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join all of ``values`` which are connected by ``max_bits`` differing bits or fewer."""
    links: list[tuple[int, int]] = []
    left = np.arange(len(values))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= max_bits
            links += [(int(at), int(x)) for x in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return links


def run_links(variants: DataFrame, paired_bucket: int) -> DataFrame:
    """(a, b) links inside the buckets of ``variants`` (fp, key), and (a, null) for each fingerprint of a larger bucket than ``paired_bucket``.

    Variants are shuffled once and sorted, so a bucket is a run of rows; no more of a run is held than ``paired_bucket`` and a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints, crowded = np.empty(0, np.int64), np.empty(0, np.int64), None  # the run that is not over, and the key of one that is too long

        def links_of(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            """Of whole runs of at most ``paired_bucket`` rows."""
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
            sizes = np.diff(np.append(starts, len(keys)))
            two = starts[sizes == 2]
            two = two[np.bitwise_count(prints[two].view(np.uint64) ^ prints[two + 1].view(np.uint64)) <= MAX_BITS]
            a, b = [prints[two]], [prints[two + 1]]
            for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                members = prints[start : start + size]
                links = np.array(spanning_links(members.view(np.uint64), MAX_BITS), np.int64).reshape(-1, 2)
                a.append(members[links[:, 0]])
                b.append(members[links[:, 1]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

        def alone(prints: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(prints), pa.nulls(len(prints), pa.int64())], names=["a", "b"])

        for batch in filter(len, batches):
            keys = np.concatenate((keys, batch.column("key").to_numpy()))
            prints = np.concatenate((prints, batch.column("fp").to_numpy()))
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(starts, len(keys)))
            long = (sizes > paired_bucket) | (keys[starts] == crowded if crowded is not None else False)
            crowded = keys[-1] if long[-1] else None
            over = np.repeat(long, sizes)
            yield alone(prints[over])
            last = len(keys) if long[-1] else starts[-1]
            done = ~over[:last]
            yield links_of(keys[:last][done], prints[:last][done])
            keys, prints = keys[last:], prints[last:]
        yield links_of(keys, prints)

    dealt = variants.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.select("key", "fp").mapInArrow(run, "a long, b long")


def ball_links(points: DataFrame) -> DataFrame:
    """(a, b) links that connect all of ``points`` (fp) within three bits, by points near both."""
    flips = [0] + [1 << i for i in range(64)]
    pairs = [(1 << i) | (1 << j) for i, j in combinations(range(64), 2)]
    near = np.array(flips, dtype=np.uint64)
    far = np.array(pairs, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp in batch.column("fp").to_numpy().view(np.uint64):
                around = np.concatenate((near, far)) ^ fp
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(around.view(np.int64)),
                        pa.array(np.full(len(around), fp).view(np.int64)),
                        pa.array(np.arange(len(around)) < len(near)),
                    ],
                    names=["point", "fp", "near"],
                )

    listed = points.mapInArrow(run, "point long, fp long, near boolean")
    # A point has at most 65 fingerprints within one bit and 2016 at two bits.
    centre = listed.where("near").groupBy("point").agg(F.min("fp").alias("a"))
    return listed.join(centre, "point").select("a", F.col("fp").alias("b")).where("a <> b")


def fingerprint_links(points: DataFrame, paired_bucket: int = PAIRED_BUCKET) -> DataFrame:
    """(a, b) links between distinct fingerprints (fp) that connect all pairs within three bits."""
    # Few bytes before 64 rows for each: dealt out again, or a few tasks would make all variants.
    variants = deletion_variants(points.repartition(shuffle_width(points.sparkSession), "fp"))
    found = materialize(run_links(variants, paired_bucket))
    crowded = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    return found.where("b is not null").unionByName(ball_links(crowded))


def linked_classes(prints: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """fp, n (its rows) and component_id: the smallest doc_id that is reachable over the links of the distinct fingerprints."""
    points = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")))
    labels = connected_components(links_of(points.select("fp")))
    linked = labels.join(points, labels["node"] == points["fp"]).select("fp", "n", "least_id", "component")
    least = materialize(linked.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("size")))
    joined = joined_by_key(linked, least, "component", "size").select("fp", "n", "component_id")
    alone = points.join(labels, points["fp"] == labels["node"], "left_anti").select("fp", "n", F.col("least_id").alias("component_id"))
    return materialize(joined.unionByName(alone))


def near_duplicates(prints: DataFrame, paired_bucket: int = PAIRED_BUCKET) -> DataFrame:
    """fp, n and component_id: the smallest doc_id that is reachable over links, for distinct fingerprints."""
    return linked_classes(prints, lambda points: fingerprint_links(points, paired_bucket))


def document_components(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = materialize(fingerprints(docs, width))
    classes = near_duplicates(prints)
    return joined_by_key(prints, classes, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, width: int = 3) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller doc_id; all columns.

    A row without doc_id is kept. Rows are told apart by doc_id and a hash of their text.
    """
    prints = materialize(fingerprints(docs, width))
    return without_linked(docs, prints, near_duplicates(prints))


def without_linked(docs: DataFrame, prints: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose class in ``classes`` (fp, n, component_id) has no smaller doc_id."""
    lost = joined_by_key(prints, classes, "fp", "n").where("doc_id <> component_id")
    key, ident = fresh_name(docs, "text_key_"), fresh_name(docs, "lost_id_")
    lost = lost.select(F.col("text_key").alias(key), F.col("doc_id").alias(ident)).distinct()
    marked = docs.withColumn(key, F.xxhash64("text"))
    same = (marked[key] == lost[key]) & (marked["doc_id"].cast("long") == lost[ident])
    return marked.join(lost, same, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
