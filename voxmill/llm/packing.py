"""Packing of documents into windows of a fixed number of tokens by best-fit decreasing.

A document's ids are cut into full windows first. What remains of each document of a block is placed
in decreasing order of length: a segment tree over the remaining capacities finds the open window
with the least room that still holds it. Windows that stay open are then closed: the emptiest ones
give their tokens to the gaps of the fullest, and the last open window of a block is divided into
lengths that are powers of two, which need no padding.

Each task packs the documents of its own partition in blocks of a bounded number of tokens, so
nothing is shuffled, memory does not grow with the partition, and no group of rows is gathered.
Equal rows are packed as often as they occur; a null text has only the closing id; texts of any length
are encoded whole. Other columns are not read, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_spec
from .rank_tokens import encode

#: Tokens that are packed together; the memory of a task is bounded by it and its longest document.
BLOCK_TOKENS = 4_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: (document, start, length)
Piece = tuple[int, int, int]


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree over the capacities."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.filled = bytearray(2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, window: int, room: int) -> None:
        self.stacks[room].append(window)
        node = self.leaves + room
        while node and not self.filled[node]:
            self.filled[node] = 1
            node >>= 1

    def take_tightest(self, length: int) -> tuple[int, int] | None:
        """Remove and return (window, room) with the least room of at least ``length``."""
        node = self.leaves + length
        if not self.filled[node]:
            while node > 1 and not (node % 2 == 0 and self.filled[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.filled[2 * node] else 2 * node + 1
        room = node - self.leaves
        window = self.stacks[room].pop()
        if not self.stacks[room]:
            self.filled[node] = 0
            node >>= 1
            while node and not (self.filled[2 * node] or self.filled[2 * node + 1]):
                self.filled[node] = 0
                node >>= 1
        return window, room


def powers_of_two(n: int) -> list[int]:
    return [1 << bit for bit in reversed(range(n.bit_length())) if n >> bit & 1]


def close_windows(windows: list[list[Piece]], rooms: list[int], window: int) -> list[list[Piece]]:
    """Fill the gaps of the fullest windows from the emptiest ones; divide the one that is left."""
    closed = [w for w, room in zip(windows, rooms, strict=True) if room == 0]
    partial = sorted((room, i) for i, room in enumerate(rooms) if room)
    fullest, emptiest = 0, len(partial) - 1
    while fullest < emptiest:
        gap, i = partial[fullest]
        own, donor = windows[i], windows[partial[emptiest][1]]
        while gap and donor:
            doc, start, length = donor.pop()
            given = min(gap, length)
            own.append((doc, start + length - given, given))
            gap -= given
            if given < length:
                donor.append((doc, start, length - given))
        if gap:
            partial[fullest] = gap, i
            emptiest -= 1
        else:
            closed.append(own)
            fullest += 1
            if not donor:
                emptiest -= 1
    if fullest == emptiest:
        rest = windows[partial[fullest][1]]
        for size in powers_of_two(sum(length for _, _, length in rest)):
            part: list[Piece] = []
            while size:
                doc, start, length = rest.pop(0)
                taken = min(size, length)
                part.append((doc, start, taken))
                size -= taken
                if taken < length:
                    rest.insert(0, (doc, start + taken, length - taken))
            closed.append(part)
    return closed


def pack_lengths(lengths: list[int], window: int) -> list[list[Piece]]:
    """Windows of (document, start, length) pieces for documents of the given positive lengths."""
    full: list[list[Piece]] = []
    rests: list[tuple[int, int, int]] = []
    for doc, length in enumerate(lengths):
        full += [[(doc, start, window)] for start in range(0, length - window + 1, window)]
        if length % window:
            rests.append((length % window, doc, length - length % window))
    rests.sort(key=lambda rest: (-rest[0], rest[1]))
    open_windows = OpenWindows(window)
    windows: list[list[Piece]] = []
    rooms: list[int] = []
    for length, doc, start in rests:
        if found := open_windows.take_tightest(length):
            i, room = found
            windows[i].append((doc, start, length))
        else:
            i, room = len(windows), window
            windows.append([(doc, start, length)])
            rooms.append(window)
        rooms[i] = room - length
        if rooms[i]:
            open_windows.put(i, rooms[i])
    return full + close_windows(windows, rooms, window)


def pack_block(doc_ids: list[int | None], ids: list[np.ndarray], window: int, first_sequence: int) -> tuple[pa.RecordBatch, int]:
    """Piece rows of a block of documents, and the number of sequences they fill."""
    columns: list[list] = [[] for _ in range(7)]
    windows = pack_lengths([len(x) for x in ids], window)
    for number, pieces in enumerate(windows):
        offset = 0
        for doc, start, length in pieces:
            crc = zlib.crc32(ids[doc][start : start + length].tobytes())
            row = (doc_ids[doc], start, length, crc, len(ids[doc]), first_sequence + number, offset)
            for column, value in zip(columns, row, strict=True):
                column.append(value)
            offset += length
    names = [field.split(" ")[0] for field in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names), len(windows)


def pack_documents(docs: DataFrame, path: str, window: int = 2048, closing_id: int = 1) -> DataFrame:
    """Pieces of all documents in windows of ``window`` tokens; ``closing_id`` ends each document.

    Sequence ids are unique over the table: the partition's number in the high 31 bits, a running
    number in the low 32.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    end = np.array([closing_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = np.concatenate((encode(spec.value, text.as_py() or ""), end))
                doc_ids.append(doc_id)
                ids.append(own)
                size += len(own)
                if size >= BLOCK_TOKENS:
                    rows, used = pack_block(doc_ids, ids, window, sequence)
                    yield rows
                    sequence += used
                    doc_ids, ids, size = [], [], 0
        if ids:
            yield pack_block(doc_ids, ids, window, sequence)[0]

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, PIECES)
