"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, edit_prints, exact_dedup, language, licenses, merkle, oracles, packing, quality, simhash, token_counts, topk, url_rules
from .common import crc_fold, table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_rules(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), crc_fold("doc_id", 5) != 0)
    scored = quality.with_score(docs, model, "score")
    held_out = F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_map(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"), licenses.fit_licences(spark))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language.fit_profiles(docs, crc_fold("doc_id", 4) != 2)
    found = language.predict_languages(docs, profiles)
    return found.select("doc_id", F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.document_lengths(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
    return token_counts.length_report(lengths)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.document_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_prints.compare_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    mined = url_rules.mine_rules(url_rules.labelled_urls(pages, table(spark, sf_dir, "labels")))
    return url_rules.judge_urls(pages, mined)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.nearest_rows(vectors, "vec_id", "embedding", F.col("id") % 20 == 0, 20)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


#: Over the whole table: keep the row with the largest doc_id of equal texts.
OP2_SQL = """
WITH hashed AS (
    SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, row_number() OVER () AS n FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST, n) = 1 AS kept,
       text_sha256
FROM hashed
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_quality, op2_exact_dedup, op3_packing, op4_licence_scan, op5_language_id, op6_bpe_round_trip,
        op7_token_counts, op8_simhash_dedup, op9_order_minhash, op10_url_filter,
        op11_conversation_repair, op12_exact_topk, op13_merkle_manifest,
    )
    return {query.__name__: query for query in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": OP2_SQL,
        "op11_conversation_repair": oracles.OP11_SQL,
        "op12_exact_topk": oracles.OP12_SQL,
        "op13_merkle_manifest": oracles.OP13_SQL,
    }
