"""Repair of the structure of conversations: an error-correcting Earley parser over a weighted role grammar.

A conversation is right if its roles read ``(system? (user assistant)+)?``. Productions beside the right ones
stand for edits: a message is deleted, its role is changed, or an empty one is inserted, each at a
cost. An item of the chart keeps the least (cost, audit), audit being the initials of its edits, and
the least completed item of the last column is the repair. The grammar is left-linear, so a column has as
many items as the grammar has symbols, whatever the length.

Messages are put in order by one sort over all conversations, which deals a conversation of any size
over many tasks. A task parses a conversation that lies within it and is short at once. Any other
is parsed in blocks, from every symbol that may stand before a block, and what blocks cost is put
together afterwards, so no task parses more than its share of a long conversation. A repaired text's digest is
one sequential hash: the messages of a divided conversation pass through one task for it, as a
sorted stream of which a task holds one batch and the audit.

Null roles and texts count as one space, which is blank. Messages of a conversation are ordered by turn, nulls first,
then by role and text; a null conv_id is a conversation of its own. Repeated rows are repeated messages. A
role of no initial can't be kept. Texts of any length are read whole. Extra columns are left alone, whatever
their names. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_width

#: What counts as white space in a message.
BLANKS = " \t\n\x0b\x0c\r"
#: Messages and characters of a block that is parsed at once.
BLOCK_MESSAGES, BLOCK_CHARS = 512, 4_000_000

#: Symbols of the grammar: what has been said so far, and the message that comes next.
NOTHING, SYSTEM, USER, PAIRS = "nothing", "system", "user", "pairs"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: (symbol, before it, kind of message, edits): a symbol follows another by a message that is edited so.
GRAMMAR = [
    (SYSTEM, NOTHING, "s", (KEEP,)),
    *((USER, before, "u", (KEEP, REROLE, INSERT)) for before in (NOTHING, SYSTEM, PAIRS)),
    (PAIRS, USER, "a", (KEEP, REROLE, INSERT)),
    *((symbol, symbol, "", (DELETE,)) for symbol in (NOTHING, SYSTEM, USER, PAIRS)),
]
COMPLETE = (NOTHING, PAIRS)
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}

Item = tuple[int, str]  # cost, audit


def predicted(symbol: str) -> list[tuple[str, str, str]]:
    """The productions that go on from ``symbol``: what they make, the initial they take, the edit."""
    return [(made, initial, edit) for made, before, initial, edits in GRAMMAR if before == symbol for edit in edits]


PREDICTED = {symbol: predicted(symbol) for symbol in (NOTHING, SYSTEM, USER, PAIRS)}


def completed(column: dict[str, Item]) -> dict[str, Item]:
    """A column with what insertions add to it; the least item of a symbol is settled first."""
    agenda = [(item, symbol) for symbol, item in column.items()]
    agenda.sort()
    done: dict[str, Item] = {}
    while agenda:
        (cost, audit), symbol = heappop(agenda)
        if symbol in done:
            continue
        done[symbol] = cost, audit
        for made, _, edit in PREDICTED[symbol]:
            if edit == INSERT and made not in done:
                heappush(agenda, ((cost + COST[INSERT], audit + INSERT), made))
    return done


def scanned(column: dict[str, Item], message: str) -> dict[str, Item]:
    """The column after a message, from the completed one before it.

    A message is the initial of its role, or ``!`` if it must be deleted; in upper case it is truncated.
    """
    initial, cut = message.lower(), message.isupper()
    after: dict[str, Item] = {}
    for symbol, (cost, audit) in column.items():
        for made, wanted, edit in PREDICTED[symbol]:
            if edit == INSERT or initial == "!" and edit != DELETE or edit == KEEP and initial != wanted:
                continue
            item = cost + COST[edit] + (cut and edit != DELETE), audit + edit
            if made not in after or item < after[made]:
                after[made] = item
    return after


@lru_cache(maxsize=20_000)
def chart(messages: str, before: str = NOTHING) -> dict[str, Item]:
    """The last column over ``messages`` that follow ``before``: the least item of each symbol."""
    column = completed({before: (0, "")})
    for message in messages:
        column = completed(scanned(column, message))
    return column


def least(column: dict[str, Item]) -> Item:
    """The cheapest complete item; of equal ones the one whose audit is least in ASCII."""
    return min(column[symbol] for symbol in COMPLETE if symbol in column)


def symbol_of(role: str, must_go: bool, cut: bool) -> str:
    """How a message reads to the parser; a role whose initial stands for none of the grammar's reads ``x``."""
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return "!" if must_go else initial.upper() if cut else initial


class Repair:
    """The text of a conversation that an audit makes of its messages, taken in one by one and hashed."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.said, self.lines, self.hash = audit, 0, NOTHING, 0, hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1
        self.said = {"s": SYSTEM, "u": USER, "a": PAIRS}[role[0]]

    def due(self) -> str:
        return "assistant" if self.said == USER else "user"

    def insert(self) -> None:
        while self.audit[self.at : self.at + 1] == INSERT:
            self.line(self.due(), "")
            self.at += 1

    def take(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit != DELETE:
            self.line(role if edit == KEEP else self.due(), text)

    def digest(self) -> str:
        self.insert()
        return self.hash.hexdigest()


ORDER = ["conv_id", "turn", "role", "text", "row"]
PARTS = "conv_id long, task long, block long, before string, after string, cost long, audit string, illegal long, first string, last string, sha256 string"
PARTS_ARROW = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in PARTS.split(", "))])


def broken(first: str, second: str) -> bool:
    """Whether two roles may not stand side by side."""
    return first[:1] + second[:1] not in ("su", "ua", "au")


def parsed_blocks(batches: Iterator[pa.RecordBatch], block_messages: int = BLOCK_MESSAGES, block_chars: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Of sorted messages of one task: whole conversations with their repair, and the charts of blocks of others.

    The first and the last conversation of a task may go on in another, and give blocks.
    """
    out: list[tuple] = []
    held: list[tuple[str, str, str]] = []  # role, text, symbol
    conv, task, block, chars, inner, began = None, 0, 0, 0, False, False

    def flush(ended: bool) -> None:
        nonlocal held, chars, block
        if not held:
            return
        messages, roles = "".join(s for _, _, s in held), [r for r, _, _ in held]
        wrong = sum(map(broken, roles, roles[1:]))
        if ended and inner and not block:
            cost, audit = least(chart(messages))
            repair = Repair(audit)
            for role, text, _ in held:
                repair.take(role, text)
            out.append((conv, None, None, None, None, cost, audit, wrong, None, None, repair.digest()))
        else:
            for before in PREDICTED:
                for after, (cost, audit) in chart(messages, before).items():
                    out.append((conv, task, block, before, after, cost, audit, wrong, roles[0], roles[-1], None))
        held, chars, block = [], 0, block + 1

    def made() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), PARTS_ARROW.types)], schema=PARTS_ARROW)
        out.clear()
        return batch

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "task", "role", "text", "must_go", "cut"))
        for own, at, role, text, must_go, cut in zip(*columns):
            if not began or own != conv:
                flush(ended=True)
                conv, task, block, inner, began = own, at, 0, began, True
            held.append((role, text, symbol_of(role, must_go, cut)))
            chars += len(text)
            if len(held) >= block_messages or chars >= block_chars:
                flush(ended=False)
        if out:
            yield made()
    flush(ended=False)
    if out:
        yield made()


def joined_blocks(key: tuple, blocks: pa.Table) -> pa.Table:
    """conv_id, cost, audit, illegal of a divided conversation, from the charts of its blocks in order."""
    best: dict[str, Item] = {NOTHING: (0, "")}
    illegal, last = 0, None
    rows = sorted(blocks.to_pylist(), key=lambda r: (r["task"], r["block"]))
    at = 0
    while at < len(rows):
        here = [r for r in rows[at : at + len(PREDICTED) ** 2] if (r["task"], r["block"]) == (rows[at]["task"], rows[at]["block"])]
        at += len(here)
        column: dict[str, Item] = {}
        for r in here:
            if r["before"] in best:
                cost, audit = best[r["before"]]
                item = cost + r["cost"], audit + r["audit"]
                if r["after"] not in column or item < column[r["after"]]:
                    column[r["after"]] = item
        illegal += here[0]["illegal"] + (last is not None and broken(last, here[0]["first"]))
        best, last = column, here[0]["last"]
    cost, audit = least(best)
    return pa.table({"conv_id": pa.array([key[0].as_py()], pa.int64()), "cost": [cost], "audit": [audit], "illegal": pa.array([illegal], pa.int64())})


def hashed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, sha256 of the repaired texts of sorted messages; the audit comes before a conversation's messages."""
    repair, conv = None, None
    for batch in batches:
        done: list[tuple] = []
        for own, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if audit is not None:
                if repair:
                    done.append((conv, repair.digest()))
                repair, conv = Repair(audit), own
            else:
                repair.take(role, text)
        if done:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([c for c, _ in done], pa.int64()), "sha256": [h for _, h in done]})
    if repair:
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "sha256": [repair.digest()]})


def with_faults(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, row, and blank, duplicate, truncated: the first fault of each message.

    A message repeats another if an earlier one of its conversation has its role and text. The earliest of each are
    found by an aggregation, and marked by their unique row, so that no repeated message is a key that rows meet at.
    """
    rows = materialize(
        messages.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        ).withColumn("row", F.monotonically_increasing_id())
    )
    place = F.struct(F.col("turn").isNotNull(), "turn", "row")  # nulls first
    earliest = rows.groupBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.min(place).alias("place"))
    met = rows.join(earliest.select(F.col("place.row").alias("row"), F.lit(True).alias("earliest")), "row", "left")
    shown = F.rtrim("text", F.lit(BLANKS))
    blank = shown == ""
    duplicate = ~blank & F.col("earliest").isNull()
    cut = ~blank & ~duplicate & ~F.right(shown, F.lit(1)).isin(".", "!", "?")
    return met.select("conv_id", "turn", "role", "text", "row", blank.alias("blank"), duplicate.alias("duplicate"), cut.alias("truncated"))


def repair_conversations(messages: DataFrame, block_messages: int = BLOCK_MESSAGES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``messages`` has conv_id, turn, role and text. gaps is the number of turns missing between the first
    and the last, and illegal that of neighbours whose roles may not stand side by side.
    """
    faults = with_faults(messages)
    in_order = materialize(faults.orderBy(*ORDER))
    counts = in_order.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *(F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")),
    )
    read = in_order.select(
        "conv_id", F.spark_partition_id().cast("long").alias("task"), "role", "text",
        (F.col("blank") | F.col("duplicate")).alias("must_go"), F.col("truncated").alias("cut"),
    )
    parts = materialize(read.mapInArrow(lambda batches: parsed_blocks(batches, block_messages, block_chars), PARTS))
    whole = parts.where("sha256 is not null").select("conv_id", "cost", "audit", "illegal", "sha256")
    divided = materialize(parts.where("sha256 is null").groupBy("conv_id").applyInArrow(joined_blocks, "conv_id long, cost long, audit string, illegal long"))
    ids = divided.select(F.col("conv_id").alias("id_"))
    lines = in_order.join(ids, F.col("conv_id").eqNullSafe(F.col("id_")), "left_semi").select(F.lit(1).alias("after"), *ORDER, F.lit(None).cast("string").alias("audit"))
    heads = divided.select(F.lit(0).alias("after"), "conv_id", *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("row", "long"))), "audit")
    stream = lines.unionByName(heads).repartition(shuffle_width(messages.sparkSession), "conv_id").sortWithinPartitions("conv_id", "after", *ORDER[1:])
    hashes = stream.select("conv_id", "audit", "role", "text").mapInArrow(hashed_texts, "conv_id long, sha256 string")
    found = whole.unionByName(divided.join(hashes.withColumnRenamed("conv_id", "id_"), F.col("conv_id").eqNullSafe(F.col("id_"))).drop("id_"))
    met = counts.alias("c").join(found.alias("f"), F.col("c.conv_id").eqNullSafe(F.col("f.conv_id")))
    return met.select("c.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha256").alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with a part of their messages dropped, emptied, cut, repeated or given to the user.

    What becomes of a message follows from the crc32 of ``conv_id:turn``; nulls are one space there.
    """
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn")).cast("binary")) % 20
    text = F.when(lot == 1, "").when(lot == 2, F.translate(spoken("text"), ".!?", "")).otherwise(spoken("text"))
    role = F.when(lot == 4, "user").otherwise(spoken("role"))
    left = conversations.where(lot != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(lot == 3, 2).otherwise(1).alias("times_"))
    return left.withColumn("time_", F.explode(F.array_repeat(F.lit(0), F.col("times_")))).drop("times_", "time_")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """The repair of damaged ``conversations``: a row for each conv_id, also where no message is left."""
    repaired = repair_conversations(damaged(conversations)).withColumnRenamed("conv_id", "id_")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    met = ids.join(repaired, F.col("conv_id").eqNullSafe(F.col("id_")), "left")
    numbers = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    return met.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))
