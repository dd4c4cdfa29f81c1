"""Token ids by a rank table, for operators that need ids but are not about encoding itself.

The library's splitting gives up (and panics) on runs of white space of a million characters, which
the pattern does not cut. Texts with a run of LONG_RUN or more are encoded by the merge rounds of
``bpe`` instead, whole and with the same ids.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken

from .bpe import SPACE, SPLIT, byte_alphabet, shared_bpe

#: Characters of white space in a row that the library is not given.
LONG_RUN = 100_000
SPACE_RUN = re.compile(f"[{SPACE}]+")


@lru_cache(maxsize=2)
def rank_encoder(spec: str) -> tiktoken.Encoding:
    """An encoder with the ids of a byte-level ``tokenizer.json``, given its content."""
    model = json.loads(spec)
    to_byte = {char: byte for byte, char in enumerate(byte_alphabet())}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in model["model"]["vocab"].items()}
    added = {token["content"]: token["id"] for token in model.get("added_tokens", [])}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)


def has_long_run(text: str) -> bool:
    return len(text) >= LONG_RUN and any(run.end() - run.start() >= LONG_RUN for run in SPACE_RUN.finditer(text))


def encode(spec: str, text: str) -> np.ndarray:
    """Ids of the whole text as unsigned 32-bit integers, given a vocabulary's content; added tokens in it are recognised."""
    if has_long_run(text):
        return shared_bpe(spec).encode_batch([text])[0].astype("<u4")
    encoder = rank_encoder(spec)
    if any(token in text for token in encoder.special_tokens_set):
        return np.array(encoder.encode(text, allowed_special="all"), dtype="<u4")
    return np.array(encoder.encode_ordinary(text), dtype="<u4")
