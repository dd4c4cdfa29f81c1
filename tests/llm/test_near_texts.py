"""The pipeline's near-copies against exact similarities of all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from voxmill.llm import near_texts, simhash


def similarity(a: str, b: str) -> float:
    one, other = ({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (a.lower().split(), b.lower().split()))
    return len(one & other) / len(one | other)


def edited(rng: random.Random, words: list[str], places: int) -> list[str]:
    words = list(words)
    for at in rng.sample(range(len(words)), places):
        words[at] = f"edit{rng.randrange(10**9)}"
    return words


def kept_by_brute_force(rows: list[tuple[int, str]]) -> set[int]:
    label = {i: i for i, _ in rows}
    for i, (a, one) in enumerate(rows):
        for b, other in rows[:i]:
            if similarity(one, other) >= 0.8:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {i for i, own in label.items() if i == own}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    made = []
    for base in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 150, 400)))]
        for places in (0, *(rng.randrange(1, 1 + len(words) // 30) for _ in range(3))):
            made.append(" ".join(edited(rng, words, places)))
    made += ["", " \n", "two words", "Two  WORDS", "other words"]
    return list(enumerate(made))


def test_edited_copies_go_that_fingerprints_of_three_bits_miss(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = [(a, b) for i, (_, a) in enumerate(rows) for _, b in rows[:i] if a.split() and b.split() and similarity(a, b) >= 0.8]
    assert sum((simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 3 for a, b in pairs) > 20
    expected = kept_by_brute_force(rows)
    for block in (near_texts.BLOCK, 2):
        assert {r["doc_id"] for r in near_texts.keep_one_of_each(docs, block).collect()} == expected
    assert {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()} == expected


def test_links_are_exact_at_the_threshold():
    numbers = [np.arange(8, dtype=np.uint64), np.arange(10, dtype=np.uint64), np.arange(100, 109, dtype=np.uint64), np.arange(100, 107, dtype=np.uint64)]
    assert near_texts.jaccard_links(numbers) == [(0, 1)]


def test_an_empty_table_gives_an_empty_one(spark):
    assert near_texts.keep_one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0
