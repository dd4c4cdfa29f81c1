"""Order MinHash fingerprints of documents, sensitive to edit distance.

Every position of a text has a k-mer of characters, and a k-mer carries the number of times it
occurred before, so repeats count. Each of several hash functions selects its few smallest among all
pairs (k-mer, occurrence) of the text, puts them back into text order and hashes that tuple: one
signature. Two texts agree in a signature only if they share the selected k-mers in the same order,
so likeness falls with edit distance and not only with a change of content. Of pairs with equal
values, the one that stands first in the text is taken.

Positions are hashed in blocks of a fixed size and only the smallest so far are held, at one
precision for texts of every length; a task needs about thirty bytes for each character of its
longest text. The start of a text is padded, so that texts shorter than k have k-mers too. Null
counts as empty; empty texts have equal fingerprints, and so have all equal texts. Every row is
compared, repeated rows too: rows follow one another by (doc_id, text), null ids first, and rows
that are equal in both have each other as next. A table of one row has itself as next; an empty
table gives an empty one. Other columns are not read, whatever their names. Rows are put in order by ranges of
doc_id; those without one, or with the same one, lie in one range, which one task sorts with spilling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 8
SIGNATURES = 64
#: K-mers in a signature's tuple.
TUPLE = 2
#: Positions that all signatures look at together.
BLOCK = 4096
#: Positions whose k-mers are coded, and about so many whose occurrences are numbered, together.
PART = 1 << 20

GOLDEN, MIX, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x2545F4914F6CDD1D)
LARGEST = np.uint32(0xFFFFFFFF)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def factors() -> np.ndarray:
    """An odd factor of 32 bits for each signature; multiplying by it orders the pairs anew."""
    return (mixed(np.arange(1, SIGNATURES + 1, dtype=np.uint64) * GOLDEN) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def kmer_codes(characters: np.ndarray) -> np.ndarray:
    """A polynomial hash of the K characters that end at each position; K is a power of two."""
    codes = np.empty(len(characters), dtype=np.uint64)
    for start in range(0, len(characters), PART):
        before = max(start - K + 1, 0)
        code = mixed(characters[before : start + PART].astype(np.uint64) + np.uint64(1))
        code = np.concatenate((np.zeros(K - 1 - (start - before), dtype=np.uint64), code))
        factor, span = BASE, 1
        while span < K:
            with np.errstate(over="ignore"):
                code = code[:-span] * factor + code[span:]
                factor = factor * factor
            span *= 2
        codes[start : start + PART] = code
    return codes


def occurrences(codes: np.ndarray) -> np.ndarray:
    """How often each code stands before its position."""
    n = len(codes)
    # Places in the low bits make equal codes follow each other in text order.
    bits = np.uint64(max(n - 1, 1).bit_length())
    packed = np.sort((codes >> bits << bits) | np.arange(n, dtype=np.uint64))
    places = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ordered = codes[places]
    same = ordered[1:] == ordered[:-1]
    if ((packed[1:] >> bits == packed[:-1] >> bits) & ~same).any():  # different codes with equal high bits
        places = np.argsort(codes, kind="stable")
        ordered = codes[places]
        same = ordered[1:] == ordered[:-1]
    counter = np.arange(n)
    first = np.concatenate(([True], ~same))
    result = np.empty(n, dtype=np.uint64)
    result[places] = counter - np.maximum.accumulate(np.where(first, counter, 0))
    return result


def pair_hashes(characters: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each position's (k-mer, occurrence)."""
    codes = kmer_codes(characters)
    parts = len(codes) // PART + 1
    if parts == 1:
        return mixed(codes ^ (occurrences(codes) * GOLDEN))
    part = (codes % np.uint64(parts)).astype(np.uint32)  # equal codes share a part
    for number in range(parts):
        at = np.flatnonzero(part == number)
        codes[at] = mixed(codes[at] ^ (occurrences(codes[at]) * GOLDEN))
    return codes


class Least(NamedTuple):
    """Per signature the smallest values so far in order, with their pairs' hashes and places."""

    values: np.ndarray
    hashes: np.ndarray
    places: np.ndarray


def least_of(hashes: np.ndarray, first_place: int = 0, known: Least | None = None) -> Least:
    """``known`` and the pairs with ``hashes``, which lie behind it from ``first_place`` on."""
    rows = np.arange(SIGNATURES)
    least = known or Least(*(np.empty((SIGNATURES, 0), dtype=t) for t in (np.uint32, np.uint64, np.int64)))
    buffer = np.empty((SIGNATURES, min(BLOCK, len(hashes))), dtype=np.uint32)
    for start in range(0, len(hashes), BLOCK):
        block = hashes[start : start + BLOCK]
        values = buffer[:, : len(block)]
        np.multiply((block >> np.uint64(32)).astype(np.uint32)[None, :], factors()[:, None], out=values)
        at = np.empty((SIGNATURES, min(TUPLE, len(block))), dtype=np.int64)
        smallest = np.empty(at.shape, dtype=np.uint32)
        for i in range(at.shape[1]):
            at[:, i] = values.argmin(axis=1)
            smallest[:, i] = values[rows, at[:, i]]
            values[rows, at[:, i]] = LARGEST
        found = Least(smallest, block[at], at + (first_place + start))
        if least.values.shape[1]:
            joined = Least(*(np.concatenate(pair, axis=1) for pair in zip(least, found, strict=True)))
            order = np.argsort(joined.values, axis=1, kind="stable")[:, :TUPLE]
            found = Least(*(x[rows[:, None], order] for x in joined))
        least = found
    return least


def tuple_signatures(least: Least) -> np.ndarray:
    """SIGNATURES 16-bit signatures: hashes of the selected pairs in text order."""
    size = least.values.shape[1]
    if not size:
        return np.zeros(SIGNATURES, dtype=np.uint16)
    picked = least.hashes[np.arange(SIGNATURES)[:, None], np.argsort(least.places, axis=1)]
    result = np.full(SIGNATURES, np.uint64(size))
    for i in range(size):
        result = mixed(result * GOLDEN ^ picked[:, i])
    return (result >> np.uint64(48)).astype(np.uint16)


def characters_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")


def signatures(text: str) -> np.ndarray:
    """The fingerprint of a text."""
    return tuple_signatures(least_of(pair_hashes(characters_of(text))))


def as_text(prints: np.ndarray) -> str:
    return prints.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited_text(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by as much of the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class Held(NamedTuple):
    """A document that waits for the next one: what is smallest in the part that its edit keeps, and its fingerprint."""

    part: int
    doc_id: int | None
    text: str
    start: Least
    prints: np.ndarray


def held_document(part: int, doc_id: int | None, text: str) -> Held:
    hashes = pair_hashes(characters_of(text))
    kept = len(text) - len(text) // 2
    start = least_of(hashes[:kept])
    return Held(part, doc_id, text, start, tuple_signatures(least_of(hashes[kept:], kept, start)))


def edited_signatures(held: Held, edited: str) -> np.ndarray:
    """As ``signatures`` of the edited text, whose start is the held text's."""
    kept = len(held.text) - len(held.text) // 2
    return tuple_signatures(least_of(pair_hashes(characters_of(edited))[kept:], kept, held.start))


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows dealt by ranges of doc_id, each range followed by the first row of the next one.

    Columns: part, extra (false for the documents of the part), doc_id, text. Only the first ids of
    the ranges reach the driver, and only the rows with those ids are dealt twice.
    """
    bounds = docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    bounds = sorted({int(bound) for bound in bounds})
    if bounds:
        limits = F.array(*(F.lit(bound).cast("long") for bound in bounds))
        part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(limits, lambda x: x < F.col("doc_id"))))
    else:
        part = F.lit(0)
    rows = docs.withColumn("part", part.cast("int"))
    # A null id comes first of all, which min() does not see.
    first = rows.groupBy("part").agg(F.min("doc_id").alias("first_id"), F.max(F.col("doc_id").isNull()).alias("has_null")).collect()
    heads = sorted((row["part"], None if row["has_null"] else row["first_id"]) for row in first)
    own = rows.select("part", F.lit(False).alias("extra"), "doc_id", "text")
    if not heads:
        return own
    follows = [(heads[i - 1][0], heads[i][1]) for i in range(len(heads))]
    targets = docs.sparkSession.createDataFrame(follows, "part int, head long")
    extra = docs.join(F.broadcast(targets), F.col("doc_id").eqNullSafe(F.col("head")))
    return own.unionByName(extra.select("part", F.lit(True).alias("extra"), "doc_id", "text"))


def compare_with_edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprint every text, its edited text, and compare; one row per row of ``docs``.

    The next document is the one that follows by ascending doc_id (null first, then by text); after
    the last comes the first. Texts are shuffled once, by ranges of doc_id, and each range is read
    as a sorted stream of which a task holds two documents.
    """
    spark = docs.sparkSession
    ranges = ranges or 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    dealt = in_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts), ranges)
    ordered = dealt.repartition(max(1, ranges // 3), "part").sortWithinPartitions("part", "extra", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Held | None = None
        for batch in batches:
            rows: list[tuple] = []
            for part, extra, doc_id, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                part, extra = part.as_py(), extra.as_py()
                if extra and held is None:
                    continue
                now = held_document(part, doc_id.as_py(), text.as_py())
                if held is not None and held.part == part:
                    edited = edited_text(held.text, now.text)
                    changed = edited_signatures(held, edited)
                    digest = hashlib.sha256(edited.encode()).hexdigest()
                    near = likeness(held.prints, changed), likeness(held.prints, now.prints)
                    rows.append((held.doc_id, len(held.text), digest, as_text(held.prints), as_text(changed), *near))
                held = None if extra else now
            schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return ordered.mapInArrow(run, RESULT)
