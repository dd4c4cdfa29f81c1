"""Singular value decomposition of tables that are too wide for one matrix of column products.

A few random mixtures of all columns span, with near certainty, what the strongest components span.
They are sharpened by going to the columns and back, and made orthonormal by a tree of QR
factorisations: each task keeps the triangle of its rows, and triangles are stacked and factored sixteen
at a time. Rows and columns stay tables of short vectors; the driver holds a few small triangles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Rounds, cut_lineage

#: Mixtures beyond the components that are asked for, and times that they are sharpened.
MORE, SHARPENED = 10, 3
#: Triangles that are factored together, and the parts in which the products of one row or column are added first.
FAN, SALTS = 16, 16
#: Share of the largest singular value below which a component is none.
LEAST = 1e-10


def mixed(number: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Normal draws, a row of ``width`` for each number, that depend on nothing but the number, the place and the seed."""
    with np.errstate(over="ignore"):
        at = (number.astype(np.uint64)[:, None] * np.uint64(width) + np.arange(width, dtype=np.uint64)) * np.uint64(2) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        bits = []
        for step in (0, 1):
            z = (at + np.uint64(step)) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            bits.append(((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53)
    return np.sqrt(-2 * np.log1p(-bits[0])) * np.cos(2 * np.pi * bits[1])


def matrix_of(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def vectors(matrix: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(matrix.reshape(-1)), matrix.shape[1]).cast(pa.list_(pa.float64()))


def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, salt, vec: the sum of v * vec over each run of rows (key, salt, v, vec) of the same key and salt."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, salt = (batch.column(c).to_numpy() for c in ("key", "salt"))
        values = matrix_of(batch.column("vec"), batch.num_rows) * batch.column("v").to_numpy()[:, None]
        starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))))
        key, salt, sums = key[starts], salt[starts], np.add.reduceat(values, starts, axis=0)
        if held and (held[0], held[1]) == (key[0], salt[0]):
            sums[0] += held[2]
        elif held:
            key, salt, sums = np.append(held[0], key), np.append(held[1], salt), np.vstack((held[2], sums))
        held = key[-1], salt[-1], sums[-1]
        yield pa.RecordBatch.from_arrays([pa.array(key[:-1], pa.int64()), pa.array(salt[:-1], pa.int32()), vectors(sums[:-1])], names=["key", "salt", "vec"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int32()), vectors(held[2][None])], names=["key", "salt", "vec"])


def product(cells: DataFrame, key: str, other: str, table: DataFrame) -> DataFrame:
    """(key, vec): for each ``key`` the sum of v * vec over its ``cells`` (key, other, v), with vec from ``table`` (key, vec) by ``other``."""
    width = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = cells.select(F.col(key).alias("key"), F.col(other).alias("other"), "v").join(table.select(F.col("key").alias("other"), "vec"), "other")
    salted = met.select("key", F.pmod(F.hash("other"), F.lit(SALTS)).alias("salt"), "v", "vec")
    for keys in (["key", "salt"], ["key"]):  # a key with very many cells is added up in parts first
        dealt = salted.repartition(width, *keys).sortWithinPartitions(*keys)
        salted = dealt.mapInArrow(added_up, "key long, salt int, vec array<double>").select("key", F.lit(0).alias("salt"), F.lit(1.0).alias("v"), "vec")
    return salted.select("key", "vec")


def triangle(table: DataFrame, width: int) -> np.ndarray:
    """R of the QR factorisation of ``table`` (vec), by a tree of factorisations."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                r = np.linalg.qr(np.vstack((r, matrix_of(batch.column("vec"), batch.num_rows))), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()])], names=["r"])

    def stacked(key: tuple, rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(r).reshape(-1, width) for r in rows.column("r").to_pylist()]
        return pa.table({"r": [np.linalg.qr(np.vstack(parts), mode="r").tobytes()]})

    rounds = Rounds(table.sparkSession)
    held = rounds.next(table.select("vec").mapInArrow(own, "r binary"))
    while (many := held.count()) > FAN:
        group = F.pmod(F.monotonically_increasing_id(), F.lit(-(-many // FAN)))
        held = rounds.next(held.withColumn("group", group).groupBy("group").applyInArrow(stacked, "r binary"))
    parts = [np.frombuffer(row["r"]).reshape(-1, width) for row in held.collect()]
    return np.linalg.qr(np.vstack([np.zeros((1, width)), *parts]), mode="r")


def turned(table: DataFrame, by: np.ndarray) -> DataFrame:
    """(key, vec): every vec of ``table`` times a small matrix."""

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("key"), vectors(matrix_of(batch.column("vec"), batch.num_rows) @ by)], names=["key", "vec"])

    return table.select("key", "vec").mapInArrow(times, "key long, vec array<double>")


def orthonormal(table: DataFrame, width: int) -> tuple[DataFrame, int]:
    """A basis of what the columns of ``table`` (key, vec) span, and its size."""
    held = cut_lineage(table)
    _, s, vt = np.linalg.svd(triangle(held, width), full_matrices=False)
    kept = s > max(s.max(), 0.0) * LEAST
    return turned(held, vt[kept].T / s[kept]), int(kept.sum())


def wide_svd(px: DataFrame, k: int, seed: int = 42) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(u (row, k, val), vt (k, t, val), s): the first ``k`` components of a table (px, t, v), or as many as its rank has."""
    cells = cut_lineage(px.select(F.col("px").cast("long").alias("row"), F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v")).where("v <> 0"))
    width = k + MORE

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("key"), vectors(mixed(batch.column("key").to_numpy(), width, seed))], names=["key", "vec"])

    draws = cells.select(F.col("t").alias("key")).distinct().mapInArrow(draw, "key long, vec array<double>")
    rows, size = orthonormal(product(cells, "row", "t", draws), width)
    for _ in range(SHARPENED if size else 0):
        columns, size = orthonormal(product(cells, "t", "row", rows), size)
        rows, size = orthonormal(product(cells, "row", "t", columns), size)
    spark = px.sparkSession
    if not size:
        return spark.createDataFrame([], "row long, k int, val double"), spark.createDataFrame([], "k int, t int, val double"), np.empty(0)
    rows = cut_lineage(rows)
    columns = cut_lineage(product(cells, "t", "row", rows))
    _, s, turn = np.linalg.svd(triangle(columns, size), full_matrices=False)
    many = min(k, int((s > s.max() * LEAST).sum()))
    s, turn = s[:many], turn[:many].T
    part = lambda table, by, name: turned(table, by).select(F.col("key").alias(name), F.posexplode("vec").alias("k", "val"))
    right = cut_lineage(part(columns, turn / s, "t"))
    largest = right.groupBy("k").agg(F.max_by("val", F.struct(F.abs("val"), -F.col("t"))).alias("val")).collect()  # one row a component
    sign = np.ones(many)
    for row in largest:
        sign[row["k"]] = -1.0 if row["val"] < 0 else 1.0
    signs = F.broadcast(spark.createDataFrame([(i, float(x)) for i, x in enumerate(sign)], "k int, sign double"))
    signed = lambda table, *names: table.join(signs, "k").select(*names, (F.col("val") * F.col("sign")).alias("val"))
    return signed(part(rows, turn, "row"), "row", "k"), signed(right.withColumn("t", F.col("t").cast("int")), "k", "t"), s
