"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; on a single machine without it, a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return configured or tempfile.mkdtemp(prefix="voxmill-checkpoint-")


#: Setting of Spark that removes the shuffle files of an action when it ends.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions inside remove their shuffle files when they end, not when the driver next collects its garbage."""
    before = spark.conf.get(REMOVE_SHUFFLES, "false")
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage; the shuffles before it are let go."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with shuffles_removed(df.sparkSession):
        return df.checkpoint()


def is_empty(df: DataFrame) -> bool:
    """Whether ``df`` has no row; the shuffles it took are let go."""
    with shuffles_removed(df.sparkSession):
        return df.isEmpty()


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for a shuffle of few bytes before much work, which the optimizer is not to merge."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a key from which on they are joined where they lie, instead of in one task.
HOT_ROWS = 100_000
#: Keys that are broadcast at most, each with its one row.
HOT_KEYS = 10_000


def joined_by_key(rows: DataFrame, table: DataFrame, key: str, size: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined to the one row that ``table`` has for each ``key``; the result has the columns of both.

    ``size`` says how many of ``rows`` have the key, and ``table`` is cut off from its lineage. Keys with more
    than ``hot_rows``, and more than one in HOT_KEYS of all rows, are broadcast: these are at most HOT_KEYS,
    however many rows there are. A task gets no more rows of any other key than these two bounds.
    """
    with shuffles_removed(rows.sparkSession):
        total, most = (value or 0 for value in table.agg(F.sum(size), F.max(size)).first())
    bound = max(hot_rows, total // HOT_KEYS)
    if most <= bound:
        return rows.join(table, key)
    hot = table.where(F.col(size) > bound)
    met = rows.join(F.broadcast(hot.withColumn("hot_", F.lit(True))), key, "left")
    cold = met.where("hot_ is null").select(*rows.columns).join(table.where(F.col(size) <= bound), key)
    return met.where("hot_").drop("hot_").unionByName(cold)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have in any spelling of case."""
    taken = {name.lower() for name in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def evaluated_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column that later expressions read instead of repeating it.

    The optimizer merges projections, and would copy the expression into each that uses it; it does
    not merge them across a generator. What ``value`` repeats within itself, the projection below
    the generator computes once.
    """
    once = fresh_name(df, f"{name}_once")
    return df.withColumn(once, value).select(*(F.col(f"`{c}`") for c in df.columns), F.explode(F.array(once)).alias(name))


def crc_fold(doc_id, folds: int):
    """crc32 of the decimal text of ``doc_id`` modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate the slices ``flat[s : s + n]`` of all pairs of ``starts`` and ``lengths``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    index = np.repeat(starts - (ends - lengths), lengths)
    index += np.arange(total, dtype=index.dtype)
    return flat[index]


def text_groups(texts: Iterable[str], max_chars: int) -> Iterator[list[str]]:
    """Consecutive lists of texts of about ``max_chars`` characters; a longer text stands alone."""
    group: list[str] = []
    size = 0
    for text in texts:
        if group and size + len(text) > max_chars:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group
