"""The near-dedup stage takes candidates from the deletion variants of fingerprints too, and compares them exactly."""

import numpy as np

import corpus_pipeline
from voxmill.llm import near_texts, simhash


def test_fingerprints_alone_find_copies_of_few_edits(spark, monkeypatch):
    words = [f"w{i * i % 997}" for i in range(900)]
    far = [f"v{i * 7 % 991}" for i in range(900)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "edit"])), (3, " ".join(far)), (4, " ".join([*far[:-1], "edit"])), (5, "short one")]
    marks = {i: simhash.fingerprint_of(near_texts.shingle_set(t)) for i, t in rows}
    assert max((marks[a] ^ marks[a + 1]).bit_count() for a in (1, 3)) <= simhash.MAX_BITS
    # Bands that never meet: what is found comes from the fingerprints.
    monkeypatch.setattr(near_texts, "sketches", without_bands(near_texts.sketches))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()} == {1, 3, 5}


def without_bands(sketches):
    return lambda docs: sketches(docs).selectExpr("doc_id", "text_key", "fp", "array(fp) keys", "print")


def test_fingerprints_count_distinct_shingles():
    assert simhash.fingerprint_of(np.empty(0, np.uint64)) == 0
    assert simhash.fingerprint_of(np.array([5], np.uint64)) == 5
