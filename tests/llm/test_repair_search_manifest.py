"""Conversation repair, exact top-k search and the Merkle manifest against brute force and their SQL."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.llm import conversations, merkle, oracles, queries, topk

SF_DIR = "/root/testdata/sf0.001"
FOLLOWS = {"-s": "s", "-u": "u", "su": "u", "ua": "a", "au": "u"}


def spoken(value):
    return " " if value is None else str(value)


def slow_damage(rows):
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{spoken(conv)}:{spoken(turn)}".encode()) % 20
        role, text = "user" if lot == 4 else spoken(role), "" if lot == 1 else re.sub("[.!?]", "", spoken(text)) if lot == 2 else spoken(text)
        yield from [(conv, turn, role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)


def slow_repair(messages):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of one conversation, from all edits at every message."""
    messages = sorted(messages, key=lambda m: (m[1] is not None, m[1] or 0, m[2].encode(), m[3].encode()))
    faults, seen = [], set()
    for _, _, role, text in messages:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [m[1] for m in messages if m[1] is not None]

    @lru_cache(None)
    def best(at, state, inserted):
        found = [(0, "", ())] if at == len(messages) and state in "-a" else []
        if at < len(messages):
            _, _, role, text = messages[at]
            options = [(3, "D", state, ())]
            if faults[at] not in ("blank", "duplicate"):
                cut = faults[at] == "truncated"
                for edit, to, cost in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if state + to[:1] in FOLLOWS:
                        options.append((cost + cut, edit, FOLLOWS[state + to[:1]], ((to, text),)))
            for cost, edit, after, line in options:
                rest = best(at + 1, after, 0)
                found += [(cost + rest[0], edit + rest[1], line + rest[2])] if rest else []
        for role in ("user", "assistant") if inserted < 3 else ():
            if state + role[0] in FOLLOWS and (rest := best(at, FOLLOWS[state + role[0]], inserted + 1)):
                found.append((2 + rest[0], "I" + rest[1], ((role, ""),) + rest[2]))
        return min(found) if found else None

    cost, audit, lines = best(0, "-", 0)
    wrong = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(messages, messages[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    told = "\n".join(f"{role}:{text}" for role, text in lines)
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), wrong, cost, audit, hashlib.sha256(told.encode()).hexdigest()


@pytest.fixture(scope="module")
def talk():
    """Nulls in every column, empty texts, unknown roles, repeated rows and turns, one long conversation."""
    draw = random.Random(5)
    roles, texts = [None, "user", "user", "assistant", "assistant", "system", "admin", "tool", ""], [None, "", "a.", "b", "hi! ", "x\n", "é.", "z?\t", "  ", "\u3000"]
    rows = [(draw.choice([None, 1, 2, *range(3, 30)]), draw.choice([None, *range(12)]), draw.choice(roles), draw.choice(texts)) for _ in range(400)]
    long = [(77, t, draw.choice(roles), f"{t}{draw.choice(['.', ''])}") for t in range(150)]
    return [*rows, *rows[:9], *long, (99, 0, "user", "word " * 100_000 + ".")]


@pytest.mark.parametrize("block", [conversations.BLOCK_MESSAGES, 5])
def test_conversations_are_repaired_as_slowly(spark, talk, block):
    source = spark.createDataFrame([(*row, 1) for row in talk], "conv_id long, turn long, role string, text string, row int").repartition(6)
    kept = list(slow_damage(talk))
    expected = {c: slow_repair([m for m in kept if m[0] == c]) for c in {m[0] for m in kept}}
    found = {r[0]: tuple(r)[1:] for r in conversations.repair_conversations(conversations.damaged(source), block).collect()}
    assert found == expected


def test_a_conversation_without_messages_and_an_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    source = spark.createDataFrame([(gone, 0, "user", "a."), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    found = {r[0]: tuple(r)[1:] for r in conversations.damaged_and_repaired(source).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert found[None] == slow_repair(list(slow_damage([(None, None, None, None)])))
    assert conversations.damaged_and_repaired(source.limit(0)).count() == 0


def test_items_keep_the_least_audit():
    # An answer between two questions costs less than to delete one of them.
    assert conversations.least(conversations.chart("uua")) == (2, "KIKK")
    assert conversations.least(conversations.chart("x")) == (3, "D")
    assert conversations.least(conversations.chart("s")) == (3, "D")
    assert conversations.least(conversations.chart("Ua")) == (1, "KK")


def slow_nearest(rows, k):
    usable = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (query, vector) in enumerate(usable):
        if query is None or query % 20:
            continue
        scored = [(sum(map(int.__mul__, vector, other)), i) for n, (i, other) in enumerate(usable) if n != at and len(other) == len(vector)]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(query, rank + 1, i, score) for rank, (score, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"slot_rows": 40, "panel_rows": 3}])
def test_nearest_rows_are_the_slow_ones(spark, sizes):
    draw = random.Random(7)
    rows = [(draw.choice([None, *range(400)]), [draw.gauss(0, 0.2) for _ in range(5)]) for _ in range(300)]
    rows += [(n, [1.0, 0.5, 0.0, 0.0, 0.0]) for n in range(400, 520)]  # ties
    rows += [(n, [0.25]) for n in range(520, 545)] + [(560, [])] + [(580, [1e5, -1e5, 3e4]), (581, [1e5, 1e5, 1e4]), (582, [2e4, -1e5, 0.0])]
    rows += [(20, None), (40, [float("nan"), 1.0]), (60, [None, 1.0]), (80, [float("inf"), 0.0]), *rows[:3]]
    source = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, row int, score int").repartition(5)
    found = topk.nearest_rows(source, "vec_id", "embedding", F.col("id") % 20 == 0, 7, **sizes)
    assert sorted(map(tuple, found.collect()), key=str) == slow_nearest(rows, 7)
    assert topk.nearest_rows(source.limit(0), "vec_id", "embedding", F.col("id") % 20 == 0, 7).count() == 0


def test_scores_that_fit_no_long_are_refused(spark):
    source = spark.createDataFrame([(20, [1e10, 1e10]), (1, [1e10, 1e10])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="long"):
        topk.nearest_rows(source, "vec_id", "embedding", F.col("id") % 20 == 0, 7)


def slow_manifest(rows):
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*map(part, (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])))

    def tree(nodes):
        """The root, and the siblings (before, after) of each node level by level."""
        proofs, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for proof, n, place in zip(proofs, range(len(proofs)), at):
                first = place // 3 * 3
                proof.append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + 3])))
                at[n] = place // 3
            nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        return nodes[0], proofs

    by_source = {}
    for row in rows:
        by_source.setdefault(row["source"], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        by_source[source].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[source] = tree([leaf(r) for r in by_source[source]])
    root, above = tree([trees[s][0] for s in order])
    out = []
    for n, source in enumerate(order):
        for row, proof in zip(by_source[source], trees[source][1]):
            siblings = proof + above[n]
            lot = None if row["doc_id"] is None else zlib.crc32(str(row["doc_id"]).encode())
            changed = {**row, "text": row["text"].replace("\n", "")} if lot is not None and lot % 2 == 0 and row["text"] is not None else row
            node = leaf(changed)
            for before, after in siblings:
                node = h(before, node, after)
            out.append((row["doc_id"], leaf(row), trees[source][0], root, h(*(b + a for b, a in siblings)), node, node == root))
    return sorted(out, key=str)


def test_manifest_is_the_slow_one(spark):
    draw = random.Random(3)
    rows = [
        {"doc_id": draw.choice([None, *range(60)]), "source": draw.choice([None, "", "b", "b", "b", "é", "a\ud7ff"]), "lang": draw.choice([None, "en"]), "n_chars": draw.choice([None, 3]), "text": draw.choice([None, "", "x\ny", "\n", "z"])}
        for _ in range(120)
    ]
    rows += rows[:5] + [{"doc_id": 7, "source": "alone", "lang": "en", "n_chars": 1, "text": "line\n" * 50_000}]
    source = spark.createDataFrame([(*r.values(), 1, 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, index int, digest int").repartition(4)
    assert sorted(map(tuple, merkle.document_manifest(source).collect()), key=str) == slow_manifest(rows)
    assert merkle.document_manifest(source.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_exact_topk", "op13_merkle_manifest"])
def test_sql_says_the_same_over_odd_rows(spark, name, tmp_path, talk):
    """The SQL also holds where tables have nulls and repeated rows."""
    con = duckdb.connect()
    if name == "op11_conversation_repair":
        frame, table = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"), "conversations"
        frame = frame.where("conv_id is null or conv_id <> 77")
    elif name == "op12_exact_topk":
        frame, table = spark.createDataFrame([(n % 90, [float(n % 7), n / 50]) for n in range(100)] + [(0, None), (20, [None, 1.0])], "vec_id long, embedding array<float>"), "embeddings"
    else:
        frame, table = spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr("nullif(doc_id, 3) doc_id", "nullif(text, '') text", "lang", "nullif(source, 'books') source", "n_chars"), "documents"
    frame.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    own = queries.queries()[name](spark, str(tmp_path))
    expected = con.execute(f"SELECT {', '.join(own.columns)} FROM ({oracles.__dict__[name.split('_')[0].upper() + '_SQL']})").fetchall()
    assert sorted(map(tuple, own.collect()), key=str) == sorted(expected, key=str)
