"""Near-duplicates by the exact Jaccard similarity of 5-word shingle sets, found over MinHash bands.

Texts whose sets of 5-word shingles have a similarity of 0.8 differ in about ten of 64 SimHash bits,
which no split of 64 bits into segments can find by equality joins. So candidates come from two ways:
from the deletion variants of SimHash fingerprints, as ``simhash`` joins them (three bits), and from MinHash:
32 bands of 7 minima each, of which a pair at 0.8 shares one with a probability of 0.9995, and a more
similar pair is found more surely. Everything that these connect forms a group, and inside a group
texts are compared exactly, over their whole sets: no link is taken from an estimate, and none below
the similarity is made. Groups larger than BLOCK texts are first compared in blocks, each with one
common centre, so that copies of one original are connected by as many rows as there are copies. What
is not connected to most of its group by then is compared with every block of it; pairs whose texts
are connected already need no comparison.

Sets are of distinct shingles; a text of fewer than five words is one shingle, and texts without a
word are alike. Equal sets are one point, so exact copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_empty, joined_by_key, materialize, ragged_take
from .components import connected_components
from .simhash import SEED, fingerprint_links, fingerprint_of, linked_classes, shingle_hashes, without_linked

WIDTH = 5
#: The least similarity of a link, as a fraction of integers.
SIMILAR = (4, 5)
BANDS, ROWS = 32, 7
#: Texts of a group that are compared with one another in one place, or with another block.
BLOCK = 1000
#: Shingles that are hashed at once.
PART = 512


def shingle_set(text: str) -> np.ndarray:
    """Distinct hashes of the 5-word shingles of a text, sorted; never empty."""
    return distinct(shingle_hashes(text, WIDTH))


def distinct(hashes: np.ndarray) -> np.ndarray:
    found = np.unique(hashes)
    return found if len(found) else np.zeros(1, dtype=np.uint64)


def hash_family() -> tuple[np.ndarray, np.ndarray]:
    """Salts and odd factors of the BANDS * ROWS hashes."""
    draws = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), SEED) for i in range(2 * BANDS * ROWS)], dtype=np.uint64)
    return draws[::2], draws[1::2] | np.uint64(1)


def band_keys(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One key per band, different in each band, from the minima of its hashes over the whole set."""
    salts, factors = family
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for part in range(0, len(shingles), PART):
        hashed = shingles[part : part + PART, None] ^ salts
        hashed *= factors
        np.minimum(least, hashed.min(axis=0), out=least)
    data = least.astype("<u8").tobytes()
    size = 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(data[i * size : (i + 1) * size], i) for i in range(BANDS)], dtype=np.uint64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp (a hash of the shingle set), keys (of its bands) and print (its SimHash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = hash_family()
        for batch in batches:
            prints = np.empty(batch.num_rows, dtype=np.uint64)
            keys = np.empty((batch.num_rows, BANDS), dtype=np.uint64)
            marks = np.empty(batch.num_rows, dtype=np.uint64)
            for i, text in enumerate(batch.column("text")):
                shingles = distinct(shingle_hashes(text.as_py() or "", WIDTH))
                marks[i] = fingerprint_of(shingles)
                prints[i] = xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), SEED)
                keys[i] = band_keys(shingles, family)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS)
            lists = pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(prints.view(np.int64)), lists, pa.array(marks.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "fp", "keys", "print"])

    columns = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text")
    )
    return columns.mapInArrow(run, "doc_id long, text_key long, fp long, keys array<long>, print long")


def jaccard_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all of ``sets`` which are connected by pairs of the least similarity."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, columns = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(columns, kind="stable")]
    counts = np.bincount(columns)
    begins = np.cumsum(counts) - counts
    ends = np.cumsum(sizes)
    links: list[tuple[int, int]] = []
    left = np.ones(len(sets), dtype=bool)
    for start in range(len(sets)):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue and left.any():
            at = queue.pop()
            own = columns[ends[at] - sizes[at] : ends[at]]
            common = np.bincount(ragged_take(holders, begins[own], counts[own]), minlength=len(sets))
            # common / (size + size - common) >= 4 / 5, in integers
            near = left & (common * (SIMILAR[0] + SIMILAR[1]) >= SIMILAR[0] * (sizes + sizes[at]))
            found = np.flatnonzero(near).tolist()
            links += [(at, x) for x in found]
            queue += found
            left &= ~near
    return links


def block_tiles(members: DataFrame) -> DataFrame:
    """text_key, fp and tile of members (text_key, fp, component, blocks, own): each block is a tile, and the group's centre lies in all."""
    everywhere = F.when(F.col("fp") == F.col("component"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    placed = members.select("text_key", "fp", "component", F.explode(everywhere).alias("i"))
    return placed.select("text_key", "fp", F.struct("component", "i", F.lit(0).alias("j")).alias("tile"))


def rest_tiles(members: DataFrame, block: int) -> DataFrame:
    """As ``block_tiles``, for members with ``label``: each block of a group's rest meets each block of the group.

    The rest is what does not belong to the label that most of the group has. So pairs inside that
    label, which is connected already, are not compared again.
    """
    counted = members.groupBy("component", "label").agg(F.count("*").alias("n"))
    most = counted.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("left")).where("left > 0")
    split = members.join(most.withColumn("parts", F.ceil(F.col("left") / block).cast("int")), "component")
    rest = split.where("label <> main").withColumn("i", F.pmod(F.hash("fp"), F.col("parts")))
    one = rest.select("text_key", "fp", "component", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    other = split.select("text_key", "fp", "component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("own").alias("j"))
    return one.unionByName(other).distinct().select("text_key", "fp", F.struct("component", "i", "j").alias("tile"))


def tile_links(members: DataFrame) -> DataFrame:
    """(a, b) links between the texts of each tile; ``members`` has text, fp and tile."""

    def links_of(sets: list[np.ndarray], prints: list[int]) -> pa.RecordBatch:
        links = jaccard_links(sets)
        ends = [pa.array([prints[pair[side]] for pair in links], pa.int64()) for side in (0, 1)]
        return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, prints = None, [], []
        for batch in batches:
            rows = zip(batch.column("tile").to_pylist(), batch.column("fp").to_pylist(), batch.column("text"), strict=True)
            for tile, fp, text in rows:
                if tile != now:
                    if sets:
                        yield links_of(sets, prints)
                    now, sets, prints = tile, [], []
                sets.append(shingle_set(text.as_py() or ""))
                prints.append(fp)
        if sets:
            yield links_of(sets, prints)

    together = members.repartition("tile").sortWithinPartitions("tile")
    return together.select("tile", "fp", "text").mapInArrow(run, "a long, b long")


def fingerprint_candidates(points: DataFrame) -> DataFrame:
    """(a, b) pairs of shingle sets (fp) that connect all whose SimHash (print) differs in three bits at most, by deletion variants."""
    least = materialize(points.groupBy("print").agg(F.min("fp").alias("a"), F.count("*").alias("n")))
    equal = joined_by_key(points.select("fp", "print"), least, "print", "n").where("fp <> a").select("a", F.col("fp").alias("b"))
    links = fingerprint_links(least.select(F.col("print").alias("fp"))).select(F.col("a").alias("one"), F.col("b").alias("other"))
    ends = least.select("print", "a")
    first = links.join(ends.withColumnRenamed("print", "one"), "one")
    return equal.unionByName(first.join(ends.select(F.col("print").alias("other"), F.col("a").alias("b")), "other").select("a", "b"))


def similar_links(docs: DataFrame, prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) links between fingerprints of shingle sets that connect all similar ones."""
    points = prints.groupBy("fp").agg(F.min_by("keys", "text_key").alias("keys"), F.min("text_key").alias("text_key"), F.first("print").alias("print"))
    points = materialize(points)
    listed = points.select("fp", F.explode("keys").alias("key"))
    shared = listed.groupBy("key").agg(F.min("fp").alias("centre"), F.max("fp").alias("last"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(shared)
    of_two = shared.where("n = 2").select(F.col("centre").alias("a"), F.col("last").alias("b"))
    of_more = joined_by_key(listed, shared.where("n > 2"), "key", "n").select(F.col("centre").alias("a"), F.col("fp").alias("b"))
    groups = connected_components(of_two.unionByName(of_more).unionByName(fingerprint_candidates(points))).withColumnRenamed("node", "fp")
    sized = materialize(groups.groupBy("component").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")))
    members = joined_by_key(groups, sized, "component", "n").withColumn("own", F.pmod(F.hash("fp"), F.col("blocks")))
    members = materialize(members.join(points.select("fp", "text_key"), "fp"))
    large = sized.where("blocks > 1").select("component")
    texts = docs.select(F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    # One text of each point; equal texts have equal sets.
    texts = texts.join(members.select("text_key").distinct(), "text_key", "left_semi").groupBy("text_key").agg(F.any_value("text").alias("text"))
    links = tile_links(block_tiles(members).join(texts, "text_key"))
    if is_empty(large):
        return links
    links = materialize(links)
    labels = connected_components(links).select(F.col("node").alias("fp"), F.col("component").alias("label"))
    labelled = materialize(members.where("blocks > 1").join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    return links.unionByName(tile_links(rest_tiles(labelled, block).join(texts, "text_key")))


def keep_one_of_each(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller doc_id; all columns.

    A row without doc_id is kept. Rows are told apart by doc_id and a hash of their text.
    """
    prints = materialize(sketches(docs))
    classes = linked_classes(prints, lambda points: similar_links(docs, prints, block))
    return without_linked(docs, prints, classes)
