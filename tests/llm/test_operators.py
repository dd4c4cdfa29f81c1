"""The operators of the training-data pipeline against brute force, public libraries and held-out rows."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from voxmill.llm import bpe, components, edit_prints, exact_dedup, language, licence_texts, licenses, near_texts, packing, quality, queries, simhash, token_counts, url_rules
from voxmill.llm.common import joined_by_key

SF_DIR = "/root/testdata/sf0.001"
VOCABULARY = queries.vocabulary_path()
#: Nulls, empty texts, ties, repeated rows, odd characters and a very long text.
ODD = [
    (1, None), (2, ""), (3, "a"), (3, "a"), (4, "a"), (None, "a"), (5, " \t\n "), (6, "12345 \ud7ff \u00e9t\u00e9 \U0001f600 <|endoftext|> it's\n\n  x"),
    (7, "lorem ipsum " * 20_000), (8, "lorem ipsum " * 20_000), (9, "\u3000wide\u2003space\x85line"), (10, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    """With extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", 0, 1, 2) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest_ int, score_ int").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def tokenizer():
    loaded = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def empty(df):
    return df.limit(0)


# 6, 7, 3: tokens


def test_ids_and_texts_are_the_librarys(spark, odd, docs, tokenizer):
    for table in (docs, odd):
        given = Counter((r["doc_id"], r["text"] or "") for r in table.collect())
        expected = Counter()
        for (doc_id, text), times in given.items():
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            back = tokenizer.decode(ids, skip_special_tokens=False)
            expected[doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += times
        found = bpe.round_trip_digests(table, VOCABULARY).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
        assert Counter(tuple(r) for r in found.collect()) == expected


def test_decoding_inverts_encoding(spark, odd):
    back = bpe.decode_documents(bpe.encode_documents(odd, VOCABULARY), VOCABULARY)
    assert Counter(tuple(r) for r in back.collect()) == Counter((i, t or "") for i, t in ODD)


def test_words_of_any_bytes_are_merged_as_the_library_does(tokenizer):
    own = bpe.shared_bpe(bpe.read_spec(VOCABULARY))
    rng = np.random.default_rng(11)
    alphabet = list("aabbcdet  \n\t.,'!0123\u00e9\u3000\u0301\u4e2d\U0001f600_-") + ["'s", "'ll", "\r\n", "<|endoftext|>"]
    samples = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(800)]
    ids, counts = own.encode_batch(samples)
    ends = np.cumsum(counts)
    for text, end, n in zip(samples, ends, counts, strict=True):
        assert ids[end - n : end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_words_are_merged_as_the_library_does(tokenizer):
    own = bpe.shared_bpe(bpe.read_spec(VOCABULARY))
    rng = np.random.default_rng(12)
    letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 100_000))
    samples = [letters, "a" * 5001, "x" + letters[:1500] + " and " + "aab" * 900 + " é" * 3, "7" * 2000, "中文" * 1200, letters[: bpe.LONG_WORD], letters[: bpe.LONG_WORD - 1], "=-" * 3000]
    ids, counts = own.encode_batch(samples)
    for text, end, n in zip(samples, np.cumsum(counts), counts, strict=True):
        assert ids[end - n : end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_token_counts_answer_from_the_histogram(spark, odd, docs, tokenizer):
    for table in (docs, odd):
        lengths = sorted(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in table.collect())
        histogram = token_counts.length_histogram(token_counts.document_lengths(table, VOCABULARY)).cache()
        sums = {r["n_tokens"]: r for r in token_counts.suffix_sums(histogram).collect()}
        assert {n: r["n_docs"] for n, r in sums.items()} == dict(Counter(lengths))
        for n, row in sums.items():
            assert row["truncated_total"] == sum(min(n, x) for x in lengths)
            assert (row["docs_over"], row["tokens_over"]) == (sum(x > n for x in lengths), sum(x for x in lengths if x > n))
        cut = {r["context_limit"]: r["tokens_kept"] for r in token_counts.truncated_totals(histogram, [0, 7, 512]).collect()}
        assert cut == {limit: sum(min(limit, x) for x in lengths) for limit in (0, 7, 512)}
        half = token_counts.length_quantiles(token_counts.suffix_sums(histogram), [0.5]).first()["n_tokens"]
        assert half == lengths[-(-len(lengths) // 2) - 1]
        report = token_counts.length_report(token_counts.document_lengths(table, VOCABULARY)).collect()
        assert {r["n_tokens"]: r["truncated_total"] for r in report if r["kind"] == "limit"} == {n: sum(min(n, x) for x in lengths) for n in token_counts.CONTEXT_LIMITS}
        assert {r["share_up_to"]: r["n_tokens"] for r in report if r["kind"] == "quantile"}[0.5] == half
        assert {r["n_tokens"]: r["n_docs"] for r in report if r["kind"] == "length"} == dict(Counter(lengths))
    assert token_counts.suffix_sums(token_counts.length_histogram(token_counts.document_lengths(empty(docs), VOCABULARY))).isEmpty()


def check_packing(table, pieces, tokenizer, window):
    own = Counter((r["doc_id"], r["text"] or "") for r in table.collect())
    ids = {key: np.array([*tokenizer.encode(key[1], add_special_tokens=False).ids, 1], "<u4") for key in own}
    total = sum(len(ids[key]) * times for key, times in own.items())
    assert sum(p["length"] for p in pieces) == total
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        crcs = {zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) for (d, _), x in ids.items() if d == p["doc_id"] and len(x) == p["doc_tokens"]}
        assert p["ids_crc32"] in crcs
    for own_pieces in sequences.values():
        at = 0
        for offset, length in sorted(own_pieces):
            assert offset == at
            at += length
        assert 0 < at <= window
    sizes = [sum(n for _, n in s) for s in sequences.values()]
    assert sum(window - n for n in sizes if n & (n - 1)) <= 0.01 * total


def test_packing_keeps_every_id_once(spark, odd, docs, tokenizer):
    for table, window in ((docs, 2048), (odd, 64)):
        pieces = packing.pack_documents(table, VOCABULARY, window).collect()
        check_packing(table, pieces, tokenizer, window)
    assert packing.pack_documents(empty(docs), VOCABULARY).isEmpty()


def test_tightest_window_is_found():
    rng = np.random.default_rng(2)
    tree, rooms = packing.OpenWindows(50), {}
    for step in range(2000):
        if rng.random() < 0.5:
            rooms[step] = int(rng.integers(1, 51))
            tree.put(step, rooms[step])
        else:
            length = int(rng.integers(1, 51))
            found = tree.take_tightest(length)
            fitting = [room for room in rooms.values() if room >= length]
            assert (found is None) == (not fitting)
            if found:
                assert found[1] == min(fitting) == rooms.pop(found[0])


def test_windows_hold_each_token_once():
    rng = np.random.default_rng(4)
    for _ in range(200):
        lengths = rng.integers(1, 60, rng.integers(1, 40)).tolist()
        windows = packing.pack_lengths(lengths, 16)
        places = Counter((doc, start + i) for w in windows for doc, start, n in w for i in range(n))
        assert places == Counter((doc, i) for doc, n in enumerate(lengths) for i in range(n))
        sizes = [sum(n for _, _, n in w) for w in windows]
        assert all(n == 16 or n & (n - 1) == 0 for n in sizes)


# 2: exact copies


def brute_copies(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    best = {text: max((i for i in ids if i is not None), default=None) for text, ids in groups.items()}
    return groups, best


@pytest.mark.parametrize("counters", [2, 1024])
def test_exact_copies(spark, odd, docs, counters):
    for table in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        groups, best = brute_copies(rows)
        found = exact_dedup.duplicate_map(table, counters).collect()
        expected = Counter((i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == expected
        kept = [r for r in found if r["kept"]]
        assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
        left = exact_dedup.deduplicate(table, counters)
        assert left.columns == table.columns
        assert {(r["doc_id"], r["text"] or "") for r in left.collect()} == {(best[t], t) for t in groups} and left.count() == len(groups)
    assert exact_dedup.duplicate_map(empty(docs)).isEmpty() and exact_dedup.deduplicate(empty(docs)).isEmpty()


def test_misra_gries_misses_no_frequent_key():
    rng = np.random.default_rng(6)
    keys = np.array([f"{i:032d}".encode() for i in rng.zipf(1.3, 20_000) % 5000], dtype="S32")
    found, counts = exact_dedup.misra_gries(iter(np.array_split(keys, 37)), 50)
    true = Counter(keys.tolist())
    assert {k for k, n in true.items() if n > len(keys) / 51} <= set(found.tolist())
    assert all(true[k] - len(keys) / 51 <= n <= true[k] for k, n in zip(found.tolist(), counts.tolist(), strict=True))


# 8: near copies


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for char in [*lowered, " "]:
        if char in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += char
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    ones = [0] * 64
    for shingle in shingles:
        h = xxhash.xxh64_intdigest(shingle.encode(), 42)
        for bit in range(64):
            ones[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(shingles))


def brute_components(prints):
    """Component (smallest member) of each distinct fingerprint by comparing all."""
    values = np.array(sorted(set(prints)), dtype=np.uint64)
    name = list(range(len(values)))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            a, b = name[i], name[int(j)]
            if a != b:
                name = [min(a, b) if x in (a, b) else x for x in name]
    return dict(zip(values.tolist(), name, strict=True))


@pytest.mark.parametrize("text", ["", " ", "One", "one Two", "A b c d a b c", "\u0130X \x85 y\x0bz \u00a0q", "x\ty\nz " * 50])
def test_fingerprint_is_the_slow_one(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_near_copies_of_documents(spark, docs, odd, texts):
    for table in (docs, odd):
        rows = [(r["doc_id"], r["text"] or "") for r in table.collect()]
        prints = [slow_fingerprint(t) if len(t) < 50_000 else simhash.fingerprint(t) for _, t in rows]
        component = brute_components(prints)
        least = {}
        for (doc_id, _), fp in zip(rows, prints, strict=True):
            known = least.get(component[fp])
            least[component[fp]] = doc_id if known is None else known if doc_id is None else min(known, doc_id)
        found = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.document_components(table).collect())
        assert found == Counter((i, f"{fp:016x}", least[component[fp]]) for (i, _), fp in zip(rows, prints, strict=True))
        kept = simhash.keep_one_of_each(table)
        assert kept.columns == table.columns
        assert {r["doc_id"] for r in kept.collect()} - {None} == set(least.values()) - {None}
    assert simhash.document_components(empty(docs)).isEmpty()


@pytest.mark.parametrize("paired_bucket", [256, 3])
def test_links_by_pairs_and_by_shared_points_are_complete(spark, paired_bucket):
    rng = np.random.default_rng(8)
    values = set(map(int, rng.integers(0, 1 << 63, 60)))
    for value in list(values)[:20]:
        for _ in range(4):
            value ^= int(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
            values.add(value)
    values |= {sum(1 << int(b) for b in rng.choice(32, 2, replace=False)) for _ in range(40)}  # all in one bucket of the upper segment
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    prints = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "doc_id long, fp long")
    found = {r["fp"]: r["component_id"] for r in simhash.near_duplicates(prints, paired_bucket).collect()}
    component = brute_components(list(values))
    least = {}
    for i, v in enumerate(values):
        least[component[v]] = min(i, least.get(component[v], i))
    assert found == {s: least[component[v]] for s, v in zip(signed, values, strict=True)}


@pytest.mark.parametrize("hot_rows", [0, 2, 10])
def test_hot_keys_are_joined_like_others(spark, hot_rows):
    rows = spark.createDataFrame([(i % 5 if i % 2 else 7, i) for i in range(40)] + [(99, 0), (None, 1)], "k int, v int")
    sized = rows.where("k is not null and k <> 99").groupBy("k").agg(F.count("*").alias("n"))
    found = joined_by_key(rows, sized, "k", "n", hot_rows).select("k", "v", "n").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, rows.join(sized, "k").select("k", "v", "n").collect()))


def test_components_of_a_star_and_of_a_ring(spark, monkeypatch):
    monkeypatch.setattr("voxmill.llm.common.HOT_ROWS", 3)
    edges = spark.createDataFrame([(5, i) for i in range(10, 40)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert found == {**{i: 5 for i in (5, *range(10, 40))}, **{100 + i: 100 for i in range(9)}}


def test_components_of_a_long_chain_and_of_no_edges(spark):
    rng = np.random.default_rng(9)
    names = rng.permutation(300).tolist()
    edges = spark.createDataFrame(list(zip(names[:-1], names[1:], strict=True)), "a long, b long")
    found = components.connected_components(edges)
    assert found.count() == 300 and {r["component"] for r in found.collect()} == {0}
    assert components.connected_components(empty(edges)).isEmpty()


def test_components_of_random_graphs_and_of_stars_around_their_largest_node(spark):
    rng = np.random.default_rng(4)
    graphs = [rng.integers(-300, 300, (400, 2)).tolist(), rng.integers(-1000, 1000, (700, 2)).tolist(), [[1000, i] for i in range(400)]]
    for graph in graphs:
        least = {}

        def root(node, least=least):
            while least.setdefault(node, node) != node:
                node = least[node]
            return node

        for a, b in (pair for pair in graph if pair[0] != pair[1]):
            low, high = sorted((root(a), root(b)))
            least[high] = low
        found = components.connected_components(spark.createDataFrame(graph, "a long, b long")).collect()
        assert {r["node"]: r["component"] for r in found} == {node: root(node) for node in list(least)}
        assert len(found) == len(least)


# 9: fingerprints

MASK = (1 << 64) - 1


def slow_mix(x):
    for _ in range(2):
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & MASK
    return x ^ (x >> 32)


def slow_print(text):
    """Order MinHash with dictionaries and lists, one pair after another."""
    padded = [0] * (edit_prints.K - 1) + [slow_mix(ord(c) + 1) for c in text]
    seen, pairs = Counter(), []
    for place in range(len(text)):
        code = 0
        for value in padded[place : place + edit_prints.K]:
            code = (code * 0x2545F4914F6CDD1D + value) & MASK
        pairs.append((slow_mix(code ^ (seen[code] * 0x9E3779B97F4A7C15 & MASK)), place))
        seen[code] += 1
    result = ""
    for number in range(1, edit_prints.SIGNATURES + 1):
        factor = slow_mix(number * 0x9E3779B97F4A7C15 & MASK) >> 32 | 1
        least = sorted(pairs, key=lambda pair: ((pair[0] >> 32) * factor & 0xFFFFFFFF, pair[1]))[: edit_prints.TUPLE]
        signature = len(least)
        for pair, _ in sorted(least, key=lambda pair: pair[1]):
            signature = slow_mix(signature * 0x9E3779B97F4A7C15 & MASK ^ pair)
        result += f"{signature >> 48:04x}" if least else "0000"
    return result


def agreeing(a, b):
    return np.mean([a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)])


def test_fingerprints_of_documents_and_edits(spark, docs, odd):
    for table, ranges in ((docs, 5), (docs, 1), (odd.where("doc_id is not null").dropDuplicates(["doc_id"]), 4)):
        order = sorted((r["doc_id"], r["text"] or "") for r in table.collect())
        found = {r["doc_id"]: r for r in edit_prints.compare_with_edits(table, ranges).collect()}
        assert len(found) == len(order)
        for (doc_id, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            row = found[doc_id]
            assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert 0 <= row["near_edited"] <= 1 and (text != following or row["near_next"] == 1)
            if ranges > 1 and len(text) + len(following) < 1500:
                prints = slow_print(text), slow_print(edited), slow_print(following)
                assert (row["fingerprint"], row["edited_fingerprint"]) == prints[:2]
                assert (row["near_edited"], row["near_next"]) == (agreeing(*prints[:2]), agreeing(prints[0], prints[2]))
        nearer = [r["near_edited"] > r["near_next"] for r in found.values() if r["n_chars"] > 500]
        assert not nearer or np.mean(nearer) > 0.95 or table is not docs
    assert edit_prints.compare_with_edits(empty(docs), 3).isEmpty()
    everything = edit_prints.compare_with_edits(odd, 3)
    assert everything.count() == odd.count()
    two = spark.createDataFrame([(1, "same text"), (1, "same text")], "doc_id long, text string")
    assert [r["near_next"] for r in edit_prints.compare_with_edits(two, 3).collect()] == [1.0, 1.0]


@pytest.mark.parametrize("part, block", [(5, 3), (16, 1000), (1 << 20, 7)])
def test_fingerprints_do_not_depend_on_parts_and_blocks(monkeypatch, part, block):
    monkeypatch.setattr(edit_prints, "PART", part)
    monkeypatch.setattr(edit_prints, "BLOCK", block)
    for text in ("", "a", "ab", "abcabcabc" * 9, "\U0001f600 na\u00efve" * 5, "aaaaaaaaaaaaaaaaaaaaaaaaaaa"):
        assert edit_prints.as_text(edit_prints.signatures(text)) == slow_print(text)
        held = edit_prints.held_document(0, 1, text)
        edited = edit_prints.edited_text(text, "zzzabcaaa" * 20)
        assert edit_prints.as_text(held.prints) == slow_print(text)
        assert edit_prints.as_text(edit_prints.edited_signatures(held, edited)) == slow_print(edited)


def test_equal_high_bits_of_codes_are_told_apart():
    codes = np.array([1 << 60, (1 << 60) + 1, 1 << 60, (1 << 60) + 1, 7], dtype=np.uint64)
    assert edit_prints.occurrences(codes).tolist() == [0, 0, 1, 1, 0]


def test_lengths_beyond_24_bits_keep_their_precision():
    text = "".join(np.random.default_rng(3).choice(list("abcdefgh \n"), 1 << 12).tolist()) * (1 << 12)
    a, b = edit_prints.signatures(text[: (1 << 24) - 5]), edit_prints.signatures(text + "some more")
    assert edit_prints.likeness(a, b) > 0.9


def test_fingerprints_heed_order_where_sets_do_not():
    words = [f"word{i}" for i in range(400)]
    text = " ".join(words)
    moved = " ".join(words[200:] + words[:200])
    a, b, c = (edit_prints.signatures(t) for t in (text, moved, text + " end"))
    assert edit_prints.likeness(a, c) > 0.9 > 0.75 > edit_prints.likeness(a, b) > 0.2


# 1, 5: classifiers


def test_languages_of_held_out_documents(spark, docs, odd):
    found = queries.op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = found.where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    profiles = language.fit_profiles(docs, F.lit(True))
    for row in language.predict_languages(odd.where("length(coalesce(text, '')) < 100"), profiles).collect():
        text = dict(ODD)[row["doc_id"]] if row["doc_id"] is not None else "a"
        assert (row["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= row["score"] <= 1
    assert language.predict_languages(empty(docs), profiles).isEmpty()
    assert language.fit_profiles(empty(docs), F.lit(True)) == []
    kept = language.keep_languages(odd, profiles, 0.0)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, None, 6, 7, 8, 9}
    scores = {r["doc_id"]: r["score"] for r in language.predict_languages(odd, profiles).collect()}
    nearer = {r["doc_id"] for r in language.keep_languages(odd, profiles).collect()}
    assert nearer == {i for i, score in scores.items() if score >= language.LEAST_SCORE} and 7 not in nearer  # "lorem ipsum" is in no learned language
    assert language.keep_languages(docs, []).isEmpty()
    own = {r["lang"]: r["text"] for r in docs.where("lang is not null and length(text) between 300 and 900").collect()}
    foreign = "pitkästä aikaa olemme täällä tänään ja huomenna taas kotona sydäntälven pyörteissä"
    table = spark.createDataFrame([(i, t) for i, t in enumerate([*own.values(), foreign, None, ""])], "doc_id long, text string")
    assert {r["doc_id"] for r in language.keep_languages(table, profiles).collect()} == set(range(len(own)))
    only = language.keep_languages(table, profiles, wanted=["fr"]).collect()
    assert [r["doc_id"] for r in only] == [list(own).index("fr")]


def slow_grams(text):
    """n-grams as strings: words of letters with an edge around them."""
    word = "".join(c if c.isalpha() else " " for c in text.lower())
    line = " " + " ".join(word.split()) + " "
    if line.isspace():
        return Counter()
    return Counter(line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1) if line[i : i + n] != " ")


def code_of(gram):
    code = 0
    for char in gram:
        code = code << language.WIDTH | (language.EDGE if char == " " else ord(char))
    return code


@pytest.mark.parametrize("part", [1, 2, 5, 1 << 20])
def test_ngrams_in_parts_are_the_slow_ones(monkeypatch, part):
    monkeypatch.setattr(language, "PART", part)
    for text in ("", "a", " .. ", "ab, c", "Été à la  mer!", "one two three two one", "x1y2z3 9 "):
        grams, counts = language.gram_counts(text)
        assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == {code_of(g): n for g, n in slow_grams(text).items()}


def slow_distance(text, profiles):
    counts = {code_of(g): n for g, n in slow_grams(text).items()}
    own = sorted(counts, key=lambda g: (-counts[g], g))[: language.PROFILE]
    return [
        sum(abs(dict(zip(grams.tolist(), places.tolist(), strict=True)).get(g, r + language.PROFILE) - r) for r, g in enumerate(own)) / (language.PROFILE * len(own))
        for _, grams, places in profiles
    ]


def test_out_of_place_distance_is_the_slow_one(spark, docs, texts):
    profiles = language.fit_profiles(docs, F.lit(True))
    for doc_id in sorted(texts)[:20]:
        assert language.distances(texts[doc_id], profiles) == pytest.approx(slow_distance(texts[doc_id], profiles))


def test_quality_of_held_out_documents(spark, docs, odd):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = queries.op1_quality(spark, sf_dir)
    assert scored.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "quality", "predicted").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    nothing = quality.fit_rules(docs, empty(labels), F.lit(True))
    assert {r["s"] for r in quality.with_score(odd, nothing, "s").select("s").collect()} == {0.5}
    kept = quality.keep_quality(odd, nothing)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert quality.keep_quality(empty(odd), nothing).isEmpty()


def test_statistics_count_kinds_of_characters(spark):
    text = "Ab1!\nC d?? |x{}\u00c9\u00e9"
    row = spark.createDataFrame([(text,), (None,)], "text string").select(*(c.alias(n) for n, c in quality.text_statistics(F.col("text")).items())).collect()
    found = {name: row[0][name] * len(text) for name in ("upper", "digits", "bangs", "bars", "symbols")}
    assert found == pytest.approx({"upper": 3, "digits": 1, "bangs": 3, "bars": 1, "symbols": 2})
    assert row[1]["n_chars"] == 0 and row[1]["upper"] == 0


KINDS = {"digits": "0123456789", "stops": ".,;:", "bangs": "!?", "bars": "|", "symbols": "#$%&*@<>={}[]\\^~_+/"}


def slow_statistics(text):
    text = text or ""
    chars, words, lines = max(len(text), 1), re.split(r"[ \t\r\n]+", text), text.split("\n")
    found = [len(text), chars / len(words), len(set(words)) / len(words), len(set(lines)) / len(lines), len(words) / len(lines), sum(unicodedata.category(c) == "Lu" for c in text) / chars]
    return found + [sum(c in KINDS[kind] for c in text) / chars for kind in ("digits", "stops", "bangs", "bars", "symbols")]


def test_scores_are_those_of_the_rules_one_by_one(spark, docs):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = quality.fit_rules(docs, labels, F.lit(True))
    assert model.rules
    for row in quality.with_score(docs, model, "s").collect():
        own = slow_statistics(row["text"])
        met = [w for rule, w in model.rules if all((own[f] <= bound) if sign == "<=" else (own[f] > bound) for f, sign, bound in rule)]
        assert row["s"] == pytest.approx(1 / (1 + math.exp(-model.intercept - sum(met))), abs=1e-9)


def test_rules_are_paths_of_trees():
    description = "Tree 0\n  If (feature 0 <= 1.5)\n   If (feature 2 > 3.0)\n    Predict: 0\n   Else (feature 2 <= 3.0)\n    Predict: 1\n  Else (feature 0 > 1.5)\n   Predict: 1\n"
    assert set(quality.tree_rules(description)) == {((0, "<=", 1.5),), ((0, ">", 1.5),), ((0, "<=", 1.5), (2, ">", 3.0)), ((0, "<=", 1.5), (2, "<=", 3.0))}


# 4: licences

HEADERS = {
    "apache": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
""",
    "mit": """The MIT License (MIT)

Copyright (c) 2015 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
""",
    "gpl": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
}
LINES = {
    "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "unknown", "Licensed under the Wombat License.": "unknown", "Released under GPLv3.": "gpl", "Code is GPL v2 or later.": "gpl",
    "Released under CC BY-NC 3.0.": "cc-by-nc", "Text is available under CC BY-SA 4.0.": "cc-by", "CC BY 4.0": "cc-by", "(c) 2020 Foo Inc.": "unknown",
    "She has a fishing license and a good boat.": None, "His fishing licence was lost by the river in May.": None, "Er kam mit dem Hund und mit der Frau.": None, "Nothing here": None,
}


@pytest.fixture(scope="module")
def licence_model(spark):
    return licenses.fit_licences(spark)


def slow_prediction(paragraph, model):
    grams = set(licenses.grams_of(paragraph))
    logits = [bias + sum(model.weights[g][i] for g in grams if g in model.weights) for i, bias in enumerate(model.intercepts)]
    powers = [math.exp((x - max(logits)) / model.temperature) for x in logits]
    best = model.classes[logits.index(max(logits))]
    shares = [sum(g in grams for g in own) / len(own) for own in licenses.templates().get(best, [])]
    return best, max(powers) / sum(powers), max(shares, default=0.0)


def test_licences_are_found_and_prose_is_not(spark, odd, licence_model):
    table = spark.createDataFrame([(i, line) for i, line in enumerate(LINES)] + [(100 + i, text) for i, text in enumerate(HEADERS.values())], "doc_id long, text string")
    found = [(r["doc_id"], r["family"]) for r in licenses.scan_licences(table, licence_model).collect()]
    expected = [(i, family) for i, family in enumerate(LINES.values()) if family] + [(100 + i, family) for i, family in enumerate(HEADERS)]
    assert sorted(found) == sorted(expected)  # headers once each, though they have several paragraphs
    trained = {text for _, text in licenses.training_texts()}
    assert not trained & set(LINES)
    long_text = "plain words\n\n" * 30_000 + "Released under the MIT License."
    again = spark.createDataFrame([(2, None), (3, ""), (4, long_text), (4, long_text)], "doc_id long, text string")
    assert [(r["doc_id"], r["paragraph"], r["family"]) for r in licenses.scan_licences(again, licence_model).collect()] == [(4, 30_000, "mit")] * 2
    assert licenses.scan_licences(odd, licence_model).isEmpty() and licenses.scan_licences(empty(table), licence_model).isEmpty()


def test_licences_that_no_model_saw_are_unknown(spark, licence_model):
    table = spark.createDataFrame(list(enumerate(licence_texts.UNSEEN)), "doc_id long, text string")
    found = licenses.scan_licences(table, licence_model).collect()
    assert len(found) >= 0.9 * len(licence_texts.UNSEEN) >= 9 and {r["family"] for r in found} == {"unknown"}


def test_headings_and_tags_of_all_families_are_confirmed(spark, licence_model):
    tags = {"mit": "MIT", "isc": "ISC", "apache": "Apache-2.0", "gpl": "GPL-3.0-or-later", "bsd": "BSD-3-Clause", "mpl": "MPL-2.0", "cc-by": "CC-BY-4.0", "cc-by-nc": "CC-BY-NC-4.0", "public-domain": "CC0-1.0"}
    lines = [(family, f"SPDX-License-Identifier: {tag}") for family, tag in tags.items()]
    lines += [("mit", "MIT License"), ("mit", "The MIT License (MIT)"), ("isc", "ISC License"), ("apache", "Apache License"), ("bsd", "BSD 3-Clause License"), ("mpl", "Mozilla Public License Version 2.0"), ("gpl", "GPLv3")]
    lines += [("unknown", "Licensed under the EUPL, Version 1.2."), ("unknown", "The software is provided as is, without warranty of any kind.")]
    prose = ["He gave his permission to the students of MIT.", "The apache helicopter landed.", "The general public may use the public library.", "The house was sold as is."]
    table = spark.createDataFrame([(i, text) for i, text in enumerate([text for _, text in lines] + prose)], "doc_id long, text string")
    found = {r["doc_id"]: r["family"] for r in licenses.scan_licences(table, licence_model).collect()}
    assert found == {i: family for i, (family, _) in enumerate(lines)}


def test_licence_scores_are_the_slow_ones_and_the_gate_drops_nothing(spark, docs, licence_model):
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate([*HEADERS.values(), *LINES, *(t for _, t in licenses.training_texts()[::7])])], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(extra)
    found = {(r["doc_id"], r["paragraph"]): (r["predicted"], r["probability"], r["similarity"]) for r in licenses.scored_paragraphs(table, licence_model).collect()}
    expected = {}
    for r in table.collect():
        for i, paragraph in enumerate(re.split(licenses.PARAGRAPH_END, r["text"] or "")):
            own = slow_prediction(paragraph, licence_model)
            if own[0] != "none":
                expected[r["doc_id"], i] = own
    assert found.keys() == expected.keys()
    for key, own in found.items():
        assert own[0] == expected[key][0] and own[1:] == pytest.approx(expected[key][1:])


# 10: URLs


def slow_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    stop = next((i for i, c in enumerate(rest[end:]) if c in "?#"), len(rest) - end)
    return host, rest[end : end + stop]


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?x#y", "http://example.com/en/", "http://a.example.com/en", "https://notexample.com/en/x",
    "x://com/", "http://a.net/fr/1", "http://net/es/", "http://a.net?/es/", "http://a.b#/fr/", "a://b://c/d", "http://b\nc/d", "http://x.net/es/1", "http://x.net/es/1",
]


def test_urls_are_judged_by_the_longest_rule(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    none = url_rules.mine_rules(spark.createDataFrame([], "url string, bad boolean"))
    for row in url_rules.judge_urls(pages, none).collect():
        host, path = slow_url(URLS[row["page_id"]])
        assert (row["host"], row["path"]) == (host, path)
        fits = [r for r in url_rules.LISTED if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (row["rule"], row["verdict"]) == ((best.name, best.verdict) if best else (None, "allow"))
    assert url_rules.judge_urls(empty(pages), none).isEmpty()


def slow_tokens(url):
    if url is None or "://" not in url:
        return set()
    host, path = slow_url(url)
    scheme = re.match("[a-zA-Z]+(?=://)", url)
    query = url.split("?", 1)[1].split("#")[0] if "?" in url else ""
    fragment = url.split("#", 1)[1] if "#" in url else ""
    tokens = {"s:" + (scheme[0] if scheme else "")} | {f"h:{x}" for part in (host.split("."), re.split(r"[.\-]", host)) for x in part if x}
    tokens |= {f"p:{x}" for x in re.split("[/.]", path) if x and not re.fullmatch("[0-9]+", x)} | {f"q:{x}" for x in query.split("&") if x}
    return tokens | ({f"f:{fragment}"} if fragment else set())


def slow_rules(rows, min_confidence=0.5, min_lift=1.5, z=1.96, min_support=0.002):
    """All combinations of tokens that are sure enough, without those that hold a shorter one."""
    marked = [(slow_tokens(url), bad) for url, bad in rows]
    share, counts = np.mean([bad for _, bad in marked]), Counter()
    for tokens, bad in marked:
        for size in range(1, len(tokens) + 1):
            for own in combinations(sorted(tokens), size):
                counts[own] += 1
                counts[own, "bad"] += bad
    sure = []
    for own, n in [(k, v) for k, v in counts.items() if k[-1] != "bad"]:
        c = counts[own, "bad"] / n
        bound = (c + z * z / (2 * n) - z * math.sqrt((c * (1 - c) + z * z / (4 * n)) / n)) / (1 + z * z / n)
        if bound >= min_confidence and c / share >= min_lift and counts[own, "bad"] >= min_support * len(rows):
            sure.append(frozenset(own))
    return {own for own in sure if not any(less < own for less in sure)}


def test_mined_rules_are_those_of_a_slow_miner_and_matcher(spark):
    rng = np.random.default_rng(5)
    words, rows = ["casino", "news", "win", "shop", "en", "fr"], []
    for i in range(160):
        path = rng.choice(words, 2, replace=False).tolist()
        bad = ("casino" in path and rng.random() < 0.95) or ({"win", "shop"} == set(path)) or rng.random() < 0.05
        rows.append((f"http://s{i % 3}.org/{path[0]}/{path[1]}/{i}", bool(bad)))
    mined = url_rules.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"))
    found = {frozenset([r["token"], *r["others"]]) for r in mined.collect()}
    assert found == slow_rules(rows) and frozenset(["p:casino"]) in found
    urls = [*(u for u, _ in rows), *URLS, "http://x.org/shop/win", "http://x.org/shop/fr", "http://casino.org/", "https://y.org/en/casino?a=b#c"]
    pages = spark.createDataFrame([(i % 7, u, "x") for i, u in enumerate(urls)], "page_id int, url string, token string")
    expected = Counter()
    for i, u in enumerate(urls):
        host, path = slow_url(u)
        fits = [r for r in url_rules.LISTED if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        bad = any(rule <= slow_tokens(u) for rule in found)
        expected[i % 7, host, path, best and best.name, best.verdict if best else "block" if bad else "allow"] += 1
    judged = url_rules.judge_urls(pages, mined)
    assert Counter(map(tuple, judged.collect())) == expected
    noise = spark.createDataFrame([(f"http://s.org/w{i % 4}/{i}", i % 3 == 0) for i in range(40)], "url string, bad boolean")
    assert url_rules.mine_rules(noise).isEmpty()


# The pipeline


def slow_shingles(text):
    words = re.findall("[^ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def near_classes(rows):
    """The smallest doc_id of each text's class by comparing all sets of 5-word shingles."""
    names = sorted(rows)
    sets = {i: slow_shingles(rows[i]) for i in names}
    least = {i: i for i in names}
    for i, j in combinations(names, 2):
        a, b = sets[i], sets[j]
        if min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and len(a & b) * 9 >= 4 * (len(a) + len(b)) and least[i] != least[j]:
            low, high = sorted((least[i], least[j]))
            least = {k: low if v == high else v for k, v in least.items()}
    return least


def test_pipeline_stages_take_effect(spark, docs, texts, tokenizer):
    out = corpus_pipeline.run(spark, SF_DIR).collect()
    kept = {p["doc_id"] for p in out}
    profiles = language.fit_profiles(docs, queries.crc_fold("doc_id", 4) != 2)
    rest = docs.where(F.col("doc_id").isin([i for i, t in texts.items() if any(c.isalpha() for c in t) and min(slow_distance(t, profiles)) <= 1 - language.LEAST_SCORE]))
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = quality.fit_rules(rest, labels, queries.crc_fold("doc_id", 5) != 0)
    rest = {r["doc_id"]: r["text"] for r in quality.keep_quality(rest, model).collect()}
    _, best = brute_copies(rest.items())
    rest = {i: rest[i] for i in best.values()}
    assert kept == set(near_classes(rest).values()) and 0 < len(kept) < len(texts)
    survivors = docs.where(F.col("doc_id").isin(list(kept)))
    check_packing(survivors, out, tokenizer, 2048)


def test_pipeline_of_odd_rows_and_of_none(spark, docs, odd, tmp_path):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    words = "the and of to in is that for it was on are as with his they at be this from or had by not but some what there we can out other were all your when"
    rows = [(500 + i, words + " the and of" * 40 + f" extra{i // 2}", "en", "s", 0) for i in range(4)] + [(500, rows_text, "en", "s", 0) for rows_text in [words + " the and of" * 40 + " extra0"] * 2]
    given = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars")).unionByName(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    )
    folder = str(tmp_path / "odd")
    given.withColumn("keep_id", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("row", F.lit(2)).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    docs_now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs_now, folder)
        assert after.columns == docs_now.columns, name
        after.write.parquet(f"{folder}/{name}")
        docs_now = spark.read.parquet(f"{folder}/{name}")
        assert docs_now.where("text is null or text = ''").isEmpty()  # of no language
    assert docs_now.where("text is not null").groupBy("text").count().where("count > 1").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs_now, folder)
    assert packed.where("start = 0").count() == docs_now.count()
    nothing = str(tmp_path / "nothing")
    empty(given).write.parquet(f"{nothing}/documents.parquet")
    empty(labels).write.parquet(f"{nothing}/labels.parquet")
    assert corpus_pipeline.run(spark, nothing).isEmpty()
