"""Truncated singular value decomposition of pixel x time tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .wide import wide_svd

#: Columns (frames or features) up to which the Gram matrix is decomposed in one place; more are left to random mixtures.
MAX_COLUMNS = 4000


@dataclass(frozen=True)
class Svd:
    """u (row, k, val), vt (k, t, val), s (k, val): sparse tables, k from 0."""

    u: DataFrame
    vt: DataFrame
    s: DataFrame
    rank: int


def traces(px: DataFrame, columns: int) -> DataFrame:
    """(row, trace): dense rows of a sparse table (px, t, v); a missing cell is 0."""
    cells = px.groupBy("px").agg(F.map_from_entries(F.collect_list(F.struct("t", F.col("v").cast("double")))).alias("cells"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda t: F.coalesce(F.element_at("cells", t), F.lit(0.0)))
    return cells.select(F.col("px").cast("long").alias("row"), dense.alias("trace"))


def gram_matrix(rows: DataFrame, columns: int) -> np.ndarray:
    """The matrix A^T A of ``rows`` (trace): each partition sums its own, Spark sums those by row of the matrix."""
    if columns > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns")

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((columns, columns))
        for frame in frames:
            if len(frame):
                a = np.stack(frame["trace"].to_numpy())
                total += a.T @ a
        yield pd.DataFrame({"i": np.arange(columns, dtype=np.int32), "line": list(total)})

    def add(key: tuple, lines: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "line": [np.sum(np.stack(lines["line"].to_numpy()), axis=0)]})

    parts = rows.select("trace").mapInPandas(partial, "i int, line array<double>")
    sums = parts.groupBy("i").applyInPandas(add, "i int, line array<double>").toArrow()  # columns^2 numbers, bounded by MAX_COLUMNS
    gram = np.zeros((columns, columns))
    if len(sums):
        gram[sums.column("i").to_numpy()] = sums.column("line").combine_chunks().flatten().to_numpy().reshape(-1, columns)
    return gram


def sparse_gram(px: DataFrame) -> DataFrame:
    """(i, j, g) with i <= j: products of the columns of a sparse table (px, t, v) of whole numbers, as a join."""
    a, b = px.select("px", F.col("t").alias("i"), F.col("v").alias("a")), px.select("px", F.col("t").alias("j"), F.col("v").alias("b"))
    return a.join(b, "px").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g"))


def truncated_svd(px: DataFrame, columns: int, k: int) -> Svd:
    """The first ``k`` components, or as many as the rank has, with the largest entry of each v positive.

    Only the small Gram matrix is decomposed on the driver; U = A V / S is a projection of the rows. Of more
    than MAX_COLUMNS columns there is no such matrix (see ``wide_svd``).
    """
    spark = px.sparkSession
    if columns > MAX_COLUMNS:
        u, vt, values = wide_svd(px.where(F.col("t").between(0, columns - 1)), k)
        return Svd(u, vt, spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "k int, val double"), len(values))
    rows = traces(px, columns)
    values, vectors = np.linalg.eigh(gram_matrix(rows, columns))
    order = np.argsort(-values)[:k]
    kept = order[values[order] > max(values.max(), 0.0) * 1e-12]
    s, v = np.sqrt(values[kept]), vectors[:, kept]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(len(kept))] < 0, -1.0, 1.0)
    vt = spark.createDataFrame([(i, t, float(v[t, i])) for i in range(len(kept)) for t in range(columns)], "k int, t int, val double")
    table = spark.createDataFrame([(i, float(x)) for i, x in enumerate(s)], "k int, val double")
    if not len(kept):
        return Svd(spark.createDataFrame([], "row long, k int, val double"), vt, table, 0)
    basis = spark.sparkContext.broadcast(v / s)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            traces_ = batch.column("trace").flatten().to_numpy(zero_copy_only=False).reshape(-1, columns)
            parts = traces_ @ basis.value
            ids = np.repeat(batch.column("row").to_numpy(zero_copy_only=False), parts.shape[1])
            k = np.tile(np.arange(parts.shape[1], dtype=np.int32), len(parts))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(k), pa.array(parts.reshape(-1))], names=["row", "k", "val"])

    return Svd(rows.select("row", "trace").mapInArrow(project, "row long, k int, val double"), vt, table, len(kept))


def save(svd: Svd, path: str) -> None:
    """Keep the factors as Parquet under ``path``."""
    for name in ("u", "vt", "s"):
        getattr(svd, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Svd:
    """Factors that ``save`` kept."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("u", "vt", "s")}
    return Svd(**tables, rank=tables["s"].count())


def reconstruct(svd: Svd) -> DataFrame:
    """(row, t, val): the sum over components of U S V^T.

    The right side is a matrix of components x columns, both bounded by parameters. The parts of a row are
    gathered once, and its columns are made where they lie.
    """
    right = svd.vt.join(F.broadcast(svd.s.withColumnRenamed("val", "s")), "k").select("k", "t", (F.col("val") * F.col("s")).alias("sv")).toArrow()
    k, t = (right.column(c).to_numpy() for c in ("k", "t"))
    matrix = np.zeros((k.max() + 1, t.max() + 1) if len(k) else (1, 0))
    matrix[k, t] = right.column("sv").to_numpy()
    columns = np.unique(t).astype(np.int32)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            loads = batch.column("load").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            values = (loads @ matrix)[:, columns]
            rows = np.repeat(batch.column("row").to_numpy(zero_copy_only=False), len(columns))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.tile(columns, batch.num_rows)), pa.array(values.reshape(-1))], names=["row", "t", "val"])

    cells = svd.u.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("k", "val"))).alias("cells"))
    load = F.transform(F.sequence(F.lit(0), F.lit(len(matrix) - 1)), lambda k: F.coalesce(F.element_at("cells", k), F.lit(0.0)))
    return cells.select(F.col("row").cast("long").alias("row"), load.alias("load")).mapInArrow(multiply, "row long, t int, val double")


def seed_trace(svd: Svd, row: int, colors: int) -> DataFrame:
    """(t, val): the trace of one row from components 1 to colors - 1."""
    seed = svd.u.where((F.col("row") == row) & F.col("k").between(1, colors - 1)).select("k", F.col("val").alias("u"))
    right = svd.vt.join(svd.s.withColumnRenamed("val", "s"), "k")
    return right.join(F.broadcast(seed), "k").groupBy("t").agg(F.sum(F.col("u") * F.col("s") * F.col("val")).alias("val"))
