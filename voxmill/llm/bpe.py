"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up the rank of every neighbouring
pair by binary search over the sorted pair keys, takes the lowest rank of each word, and merges all
occurrences of that pair in the word at once. Words that have no pair left are set aside, so that
later rounds only touch what is still being merged. A long word is merged by rounds of its own, each of
which takes the lowest rank that is left in it and looks only at the places where that pair stands, so
time does not grow with the product of its length and its merges.

Texts are first cut where every later cut of the splitting pattern is certain (in front of the last
white space before a word, and between plain letters and marks), and each distinct chunk is encoded once per worker, in a table of
bounded size.

Null and empty texts have no ids and decode to the empty text. Texts of any length are encoded
whole, repeated rows each. Other columns are not read, whatever their names. An empty table gives an empty one. Added tokens of the vocabulary are recognised inside texts, as the tokenizers library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged_take, text_groups

# Fixed values of the byte-level format: its splitting pattern, and Unicode's white space.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Some letters and some marks: between one of each, the pattern always splits.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = ".,;:!?#$%&*|"

SHIFT = 20
NO_RANK = np.iinfo(np.int64).max
#: Distinct chunks, and characters in them, that a worker remembers; beyond either the table starts anew.
CACHE_CHUNKS = 400_000
CACHE_CHARS = 16_000_000
#: Bytes from which on a word is merged by rounds of its own.
LONG_WORD = 1000
#: Symbols whose pairs are looked up together in a long word.
PART = 1 << 20
#: Characters that are encoded at once.
GROUP_CHARS = 2_000_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in vocabulary files.

    Printable bytes of Latin-1 stand for themselves, the others for the characters from 256 on.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    alphabet, spare = [], 256
    for byte in range(256):
        if byte in printable:
            alphabet.append(chr(byte))
        else:
            alphabet.append(chr(spare))
            spare += 1
    return alphabet


class ByteBpe:
    """An encoder and decoder for the content of a byte-level ``tokenizer.json``."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        vocab = model["model"]["vocab"]
        alphabet = byte_alphabet()
        to_byte = {char: byte for byte, char in enumerate(alphabet)}
        self.byte_ids = np.array([vocab[char] for char in alphabet], dtype=np.int64)

        merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        keys = (left << SHIFT) | right
        order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[order]
        self.pair_ranks = order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)

        self.added = {token["content"]: token["id"] for token in model.get("added_tokens", [])}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_pattern = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None

        pieces = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items() if all(c in to_byte for c in token)}
        pieces |= {i: content.encode() for content, i in self.added.items()}
        size = max([*vocab.values(), *self.added.values()]) + 1
        lengths = np.array([len(pieces.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.piece_lengths = lengths
        self.piece_starts = np.cumsum(lengths) - lengths
        self.piece_bytes = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(size)), dtype=np.uint8)

        self.split = regex.compile(SPLIT)
        self.chunk = re.compile(f"[{SPACE}]?[{LETTERS}]++(?=[{MARKS}{SPACE}]|$)|[{SPACE}]?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.known_chars = 0
        self.ids = np.empty(0, dtype=np.int32)
        self.starts = np.empty(0, dtype=np.int64)
        self.lengths = np.empty(0, dtype=np.int64)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all non-empty ``words`` in one array, and how many each word has."""
        long = [i for i, word in enumerate(words) if len(word) >= LONG_WORD]
        if long:
            return self._with_long_words(words, long)
        if not words:
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        while len(symbols):
            ranks = np.full(len(symbols), NO_RANK)
            pairs = (symbols[:-1] << SHIFT) | symbols[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, pairs), len(self.pair_keys) - 1)
            known = (self.pair_keys[at] == pairs) & (owner[:-1] == owner[1:])
            ranks[:-1][known] = self.pair_ranks[at[known]]

            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lowest = np.minimum.reduceat(ranks, first)
            counts = np.diff(np.concatenate((first, [len(owner)])))
            lowest = np.repeat(lowest, counts)
            open_ = lowest < NO_RANK
            done_symbols.append(symbols[~open_])
            done_owner.append(owner[~open_])
            symbols, owner, ranks, lowest = symbols[open_], owner[open_], ranks[open_], lowest[open_]

            chosen = ranks == lowest
            place = np.arange(len(chosen))
            run_start = chosen & ~np.concatenate(([False], chosen[:-1]))
            begin = np.maximum.accumulate(np.where(run_start, place, 0))
            chosen &= (place - begin) % 2 == 0  # of overlapping pairs, every second one
            left = np.flatnonzero(chosen)
            symbols[left] = self.merged[ranks[left]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[left + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def _with_long_words(self, words: list[bytes], long: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """As ``merge_words``, where ``long`` numbers the long words."""
        apart = set(long)
        ids, some = self.merge_words([word for i, word in enumerate(words) if i not in apart])
        ids_of_long = [self.merge_long(words[i]) for i in long]
        counts = np.empty(len(words), dtype=np.int64)
        counts[[i for i in range(len(words)) if i not in apart]] = some
        counts[long] = list(map(len, ids_of_long))
        ends = np.cumsum(counts)
        result = np.empty(int(ends[-1]), dtype=np.int32)
        inside = np.ones(len(result), dtype=bool)
        for i, own in zip(long, ids_of_long, strict=True):
            result[ends[i] - counts[i] : ends[i]] = own
            inside[ends[i] - counts[i] : ends[i]] = False
        result[inside] = ids
        return result, counts

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, by binary search; the number of merges where there is none."""
        result = np.empty(len(left), dtype=np.int32)
        for start in range(0, len(left), PART):
            pairs = (left[start : start + PART].astype(np.int64) << SHIFT) | right[start : start + PART]
            at = np.minimum(np.searchsorted(self.pair_keys, pairs), len(self.pair_keys) - 1)
            result[start : start + PART] = np.where(self.pair_keys[at] == pairs, self.pair_ranks[at], len(self.merged))
        return result

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word: rounds over ranks from the lowest on, each over the places of its pair only."""
        symbols = self.byte_ids.astype(np.int32)[np.frombuffer(word, dtype=np.uint8)]
        n, none = len(symbols), len(self.merged)
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n, dtype=np.int32)  # with a place behind the end
        alive = np.ones(n, dtype=bool)
        ranks = np.append(self.pair_rank(symbols[:-1], symbols[1:]), np.int32(none))
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enlist(places: np.ndarray) -> None:
            """Queue places by the rank of the pair that begins there."""
            places = places[ranks[places] < none]
            places = places[np.argsort(ranks[places], kind="stable")]
            own = ranks[places]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for part in np.split(places, cuts) if len(places) else ():
                rank = int(ranks[part[0]])
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(queue, rank)
                waiting[rank].append(part)

        enlist(np.arange(n, dtype=np.int32))
        while queue:
            rank = heapq.heappop(queue)
            places = np.concatenate(waiting.pop(rank))
            places = np.unique(places[ranks[places] == rank])
            if not len(places):
                continue
            # Of pairs that overlap, every second one is merged.
            starts = np.concatenate(([True], after[places[:-1]] != places[1:]))
            index = np.arange(len(places))
            begin = np.maximum.accumulate(np.where(starts, index, 0))
            chosen = places[(index - begin) % 2 == 0]
            gone = after[chosen]
            symbols[chosen] = self.merged[rank]
            ranks[gone], alive[gone] = none, False
            after[chosen] = after[gone]
            before[after[chosen]] = chosen
            touched = np.unique(np.concatenate((chosen, before[chosen])))
            touched = touched[touched >= 0]
            following = after[touched]
            inner = following < n
            ranks[touched[~inner]] = none
            touched, following = touched[inner], following[inner]
            ranks[touched] = self.pair_rank(symbols[touched], symbols[following])
            enlist(touched)
        return symbols[alive]

    def _learn(self, chunks: list[str]) -> None:
        """Add new chunks to the table of known ones."""
        words_of = [[w.encode("utf-8", "replace") for w in self.split.findall(chunk)] for chunk in chunks]
        words = list(dict.fromkeys(word for words in words_of for word in words))
        ids, counts = self.merge_words(words)
        begins = np.cumsum(counts) - counts
        number = {word: i for i, word in enumerate(words)}
        flat = np.array([number[word] for words in words_of for word in words], dtype=np.int64)
        per_chunk = np.array([len(words) for words in words_of], dtype=np.int64)
        new_ids = ragged_take(ids, begins[flat], counts[flat])
        sums = np.concatenate(([0], np.cumsum(counts[flat])))
        ends = np.cumsum(per_chunk)
        lengths = sums[ends] - sums[ends - per_chunk]
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        self.known_chars += sum(map(len, chunks))
        self.known.update(zip(chunks, range(len(self.starts), len(self.starts) + len(chunks)), strict=True))
        self.ids = np.concatenate((self.ids, new_ids))
        self.starts = np.concatenate((self.starts, starts))
        self.lengths = np.concatenate((self.lengths, lengths))

    def _chunks(self, text: str) -> list[str | int]:
        """Chunks of a text; added tokens stand in it as their ids."""
        if self.added_pattern is None or not self.added_pattern.search(text):
            return self.chunk.findall(text)
        chunks: list[str | int] = []
        end = 0
        for match in self.added_pattern.finditer(text):
            chunks += self.chunk.findall(text[end : match.start()])
            chunks.append(self.added[match.group()])
            end = match.end()
        return chunks + self.chunk.findall(text[end:])

    def _lookup(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table of all chunks of all texts, and the number of chunks of each text."""
        chunks: list[str | int] = []
        counts = np.empty(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            own = self._chunks(text)
            counts[i] = len(own)
            chunks += own
        if len(self.known) > CACHE_CHUNKS or self.known_chars > CACHE_CHARS:
            self._forget()
        places = list(map(self.known.get, chunks))
        if None in places:
            missing = list(dict.fromkeys(c for c, place in zip(chunks, places, strict=True) if place is None))
            added = [c for c in missing if not isinstance(c, str)]
            self._learn([c for c in missing if isinstance(c, str)])
            for token in added:
                self.known[token] = len(self.starts)
                self.starts = np.append(self.starts, len(self.ids))
                self.lengths = np.append(self.lengths, 1)
                self.ids = np.append(self.ids, np.int32(token))
            places = list(map(self.known.get, chunks))
        return np.array(places, dtype=np.int64), counts

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one int32 array, and the number of ids of each text."""
        places, counts = self._lookup(texts)
        lengths = self.lengths[places]
        return ragged_take(self.ids, self.starts[places], lengths), self._per_text(lengths, counts)

    def count_batch(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text, without the ids themselves."""
        places, counts = self._lookup(texts)
        return self._per_text(self.lengths[places], counts)

    @staticmethod
    def _per_text(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(lengths)))
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts]

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ``ids``; bytes that are not UTF-8 become U+FFFD."""
        data = ragged_take(self.piece_bytes, self.piece_starts[ids], self.piece_lengths[ids]).tobytes()
        sizes = self._per_text(self.piece_lengths[ids], counts)
        ends = np.cumsum(sizes)
        return [data[end - size : end].decode("utf-8", "replace") for size, end in zip(sizes.tolist(), ends.tolist(), strict=True)]


@lru_cache(maxsize=2)
def shared_bpe(spec: str) -> ByteBpe:
    """One encoder per Python worker and vocabulary."""
    return ByteBpe(spec)


def read_spec(path: str) -> str:
    """The content of a vocabulary file, read on the driver; it has a fixed size of a few MB."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encoded(batch: pa.RecordBatch, bpe: ByteBpe) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """(first row, texts, ids, number of ids of each text) of groups of rows of a batch with ``text``."""
    row = 0
    texts = batch.column("text").fill_null("").to_pylist()
    for group in text_groups(texts, GROUP_CHARS):
        ids, counts = bpe.encode_batch(group)
        yield row, group, ids, counts
        row += len(group)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and its token ids (array of int) of every document."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared_bpe(spec.value)
        for batch in batches:
            for row, group, ids, counts in encoded(batch, bpe):
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                doc_ids = batch.column("doc_id").slice(row, len(group))
                yield pa.RecordBatch.from_arrays([doc_ids, arrays], names=["doc_id", "ids"])

    return _ids_and_texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ``ids``; null ids decode to the empty text."""
    spec = tokens.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared_bpe(spec.value)
        for batch in batches:
            lists = [np.asarray(x or [], dtype=np.int64) for x in batch.column("ids").to_pylist()]
            counts = np.array([len(x) for x in lists], dtype=np.int64)
            texts = bpe.decode_batch(np.concatenate([np.empty(0, np.int64), *lists]), counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Rows are independent, so nothing is shuffled. Repeated rows give repeated results; an empty
    table gives an empty one.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared_bpe(spec.value)
        for batch in batches:
            for row, group, ids, counts in encoded(batch, bpe):
                data, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts) * 4
                id_hash = [hashlib.sha256(data[e - 4 * n : e]).hexdigest() for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                text_hash = [hashlib.sha256(text.encode()).hexdigest() for text in bpe.decode_batch(ids, counts)]
                doc_ids = batch.column("doc_id").slice(row, len(group))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(counts, pa.int64()), pa.array(id_hash), pa.array(text_hash)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _ids_and_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
