"""Runs of white space that the splitting of the rank library does not survive."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxmill.llm import packing, queries, token_counts
from voxmill.llm.bpe import read_spec
from voxmill.llm.rank_tokens import encode

VOCABULARY = queries.vocabulary_path()
LONG = [" " * 2_000_000, "one" + " " * 1_200_000 + "two  three<|endoftext|> ", " \n" * 750_000 + "x", "　" * 1_100_000 + "\t y"]


@pytest.fixture(scope="module")
def tokenizer():
    loaded = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def test_long_runs_of_white_space_are_encoded_as_the_library_does(spark, tokenizer):
    spec = read_spec(VOCABULARY)
    lengths = {}
    for i, text in enumerate(LONG):
        expected = tokenizer.encode(text, add_special_tokens=False).ids
        lengths[i] = len(expected)
        assert encode(spec, text).tolist() == expected
    docs = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.document_lengths(docs, VOCABULARY).collect()} == lengths
    packed = packing.pack_documents(docs, VOCABULARY).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == {i: n + 1 for i, n in lengths.items()}
