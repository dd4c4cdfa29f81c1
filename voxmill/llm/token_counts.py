"""Exact token counts from a histogram of encoded lengths.

Documents are aggregated by the number of their token ids. Sums over the histogram then answer
totals, quantiles and truncated totals for every context limit without touching a text again. The
histogram has one row per distinct length; running sums are taken inside blocks of lengths and
joined with the sums of whole blocks, so no single task orders all lengths.

A null or empty text has length 0; texts of any length are encoded whole; repeated rows count as often
as they occur; other columns are not read; an empty table has an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import read_spec
from .common import materialize
from .rank_tokens import encode

#: Lengths that share a block of running sums.
BLOCK = 4096
#: What a report answers besides the sums at each length.
CONTEXT_LIMITS = (512, 1024, 2048, 4096, 8192, 16_384, 32_768, 131_072)
QUANTILES = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)


def document_lengths(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of every whole text."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.fromiter((len(encode(spec.value, t.as_py() or "")) for t in batch.column("text")), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts)], names=["doc_id", "n_tokens"])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens and n_docs, one row per distinct length."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every distinct length: what lies at or below it, above it, and the truncated total there.

    Columns: n_tokens, n_docs, docs_up_to, tokens_up_to, docs_over, tokens_over, truncated_total
    (tokens that remain when every document is cut at this length) and share_up_to (documents).
    """
    histogram = materialize(histogram)  # read twice below; it must not encode the texts twice
    rows = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    # One row per BLOCK lengths: a document of a billion tokens adds at most a quarter million rows.
    over_all = Window.orderBy("block")
    before = over_all.rowsBetween(Window.unboundedPreceding, -1)
    whole = over_all.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("block_tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("block_docs").over(whole).alias("all_docs"),
        F.sum("block_tokens").over(whole).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("docs_in", F.sum("n_docs").over(within)).withColumn("tokens_in", F.sum("tokens").over(within))
    docs_up_to, tokens_up_to = F.col("docs_before") + F.col("docs_in"), F.col("tokens_before") + F.col("tokens_in")
    docs_over = F.col("all_docs") - docs_up_to
    return summed.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        docs_up_to.alias("docs_up_to"),
        tokens_up_to.alias("tokens_up_to"),
        docs_over.alias("docs_over"),
        (F.col("all_tokens") - tokens_up_to).alias("tokens_over"),
        (tokens_up_to + docs_over * F.col("n_tokens")).alias("truncated_total"),
        (docs_up_to / F.col("all_docs")).alias("share_up_to"),
    )


def truncated_totals(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """context_limit, docs_cut, tokens_kept and tokens_lost for each of ``limits``, from the histogram."""
    at = F.explode(F.array(*(F.lit(limit).cast("long") for limit in limits))).alias("context_limit")
    kept = F.least("n_tokens", "context_limit") * F.col("n_docs")
    return (
        histogram.select("n_tokens", "n_docs", at)
        .groupBy("context_limit")
        .agg(
            F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_cut"),
            F.sum(kept).alias("tokens_kept"),
            F.sum(F.col("n_tokens") * F.col("n_docs") - kept).alias("tokens_lost"),
        )
    )


def length_quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """share and n_tokens: the least length that at least this share of the documents does not exceed."""
    at = F.explode(F.array(*(F.lit(float(share)) for share in shares))).alias("share")
    return sums.select("n_tokens", "share_up_to", at).where("share_up_to >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def length_report(lengths: DataFrame, limits: Sequence[int] = CONTEXT_LIMITS, shares: Sequence[float] = QUANTILES) -> DataFrame:
    """All answers in one table: suffix sums at each length, truncated totals at context limits, and quantiles.

    ``kind`` is ``length``, ``limit`` or ``quantile``; columns are those of ``suffix_sums``, null where a kind has none.
    """
    histogram = materialize(length_histogram(lengths))
    sums = materialize(suffix_sums(histogram))
    cut = truncated_totals(histogram, limits).select(
        F.lit("limit").alias("kind"), F.col("context_limit").alias("n_tokens"), F.col("docs_cut").alias("docs_over"), F.col("tokens_kept").alias("truncated_total")
    )
    quantiles = length_quantiles(sums, shares).select(F.lit("quantile").alias("kind"), "n_tokens", F.col("share").alias("share_up_to"))
    rows = sums.select(F.lit("length").alias("kind"), *sums.columns)
    return rows.unionByName(cut, allowMissingColumns=True).unionByName(quantiles, allowMissingColumns=True)
