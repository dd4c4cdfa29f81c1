"""A Merkle manifest of a dataset: a digest of every row, a tree over each group, and a proof for each row.

Leaves are numbered within their group by a sort that deals a group of any size over many tasks. A
level of the tree is one window: partitioned by group and parent index, its ordered full frame
collects the run of up to three nodes, which gives the parent's preimage and each node's siblings at
once. One row per parent goes on to the next level. Sizes fall by three, and a group leaves when one
node remains. Proofs then grow from the top down: a node's proof is its own siblings and its
parent's proof, so that each join meets three rows per key and no group meets in one task. Levels that have
no more than FEW nodes in all groups together are kept in one partition, where windows and joins need no
shuffle. Texts are hashed where they are read, and only digests are shuffled.

Null values are hashed as ``-``, an empty text as ``0:``; a null group is a group of its own, ordered
first. Within a group null ids come first, and rows that repeat an id are ordered by their leaf; rows
that repeat all columns have leaves and places of their own. Texts of any length are hashed whole.
Columns that are not asked for are left alone, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Nodes of a run that become one parent.
ARITY = 3

#: Nodes of all groups up to which they stay in one partition.
FEW = 20_000

#: What a node's proof holds for one level: the run's nodes before it and after it, as hex text.
EMPTY_PROOF = "cast(array() as array<struct<before: string, after: string>>)"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows of values read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def gathered(rows: DataFrame, at_most: int) -> DataFrame:
    """``rows``, in one partition if they are few: ``at_most`` is a bound of their number."""
    return rows.coalesce(1) if at_most <= FEW else rows


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``index``, their place from 0 in their group by ``order``, and ``nodes``, the group's size.

    A sort by group and order deals rows over tasks, so a group may span many. A task's rows of a
    group are one segment; what the segments before it hold is added to a row's place in its own.
    """
    held = materialize(rows.withColumn("made_", F.monotonically_increasing_id()).orderBy(group, *order, "made_").drop("made_"))
    placed = held.withColumn("place_", F.monotonically_increasing_id()).withColumn("task_", F.spark_partition_id())
    segments = placed.groupBy("task_", group).agg(F.min("place_").alias("first_"), F.count("*").alias("size_"))
    before = Window.partitionBy(group).orderBy("task_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = segments.select(
        F.col("task_").alias("in_task_"),
        F.col(group).alias("in_group_"),
        (F.coalesce(F.sum("size_").over(before), F.lit(0)) - F.col("first_")).alias("shift_"),
        F.sum("size_").over(Window.partitionBy(group)).alias("nodes"),
    )
    met = placed.join(offsets, (F.col("task_") == F.col("in_task_")) & F.col(group).eqNullSafe(F.col("in_group_")))
    return met.select(*rows.columns, (F.col("place_") + F.col("shift_")).alias("index"), "nodes")


@dataclass(frozen=True)
class Tree:
    """The levels of the trees of all groups, from the leaves up, and a bound of the nodes of each level.

    A level has ``group``, index, nodes, digest, ``before`` and ``after``, the siblings of a node as hex
    text, and ``parent``; the last three are null for a node that remains alone in its group.
    """

    group: str
    levels: list[DataFrame]
    bounds: list[int]


def grown(leaves: DataFrame, group: str) -> Tree:
    """The trees over ``leaves`` (``group``, index, nodes, digest), each level written to the checkpoint folder.

    The driver sees the number of leaves and groups, and the size of the largest group.
    """
    size = leaves.agg(F.count("*"), F.count_if(F.col("index") == 0), F.max("nodes")).first()
    many, left = size[0], size[2] or 0
    tree = Tree(group, [], [])
    level = leaves.select(group, "index", "nodes", "digest")
    run = Window.partitionBy(group, F.floor(F.col("index") / ARITY)).orderBy("index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    while True:
        tree.bounds.append(many)
        level = gathered(level, many)
        place = (F.col("index") % ARITY).cast("int")
        alone = F.col("nodes") == 1
        met = level.withColumn("run_", F.collect_list("digest").over(run)).select(
            group, "index", "nodes", "digest",
            F.when(~alone, F.array_join(F.slice("run_", F.lit(1), place), "")).alias("before"),
            F.when(~alone, F.array_join(F.slice("run_", place + 2, F.lit(ARITY)), "")).alias("after"),
            F.when(~alone, digest(F.array_join("run_", ""))).alias("parent"),
        )
        tree.levels.append(materialize(met))
        if left <= 1:
            return tree
        first = tree.levels[-1].where((F.col("index") % ARITY == 0) & (F.col("nodes") > 1))  # one row per parent
        level = first.select(group, F.floor(F.col("index") / ARITY).alias("index"), F.ceil(F.col("nodes") / ARITY).alias("nodes"), F.col("parent").alias("digest"))
        left, many = -(-left // ARITY), min(many, many // ARITY + size[1])


def tops(tree: Tree) -> DataFrame:
    """``group`` and the digest of the node that remains of it."""
    remaining = [level.where("nodes = 1").select(tree.group, "digest") for level in tree.levels]
    top = reduce(DataFrame.unionByName, remaining)
    return gathered(top, tree.bounds[-1])


def with_proofs(tree: Tree, above: DataFrame) -> DataFrame:
    """The leaves (``group``, index, digest) with ``proof`` from the leaf up and the other columns of ``above``.

    ``above`` has one row per group: ``group``, the proof of what stands over it, and columns to pass on.
    """
    group = tree.group
    passed = [c for c in above.columns if c not in (group, "proof")]
    known = None
    for level, many in zip(reversed(tree.levels), reversed(tree.bounds), strict=True):
        same_group = F.col(f"n.{group}").eqNullSafe(F.col(f"a.{group}"))
        here = gathered(level, many)
        top = here.where("nodes = 1").alias("n").join(above.alias("a"), same_group)
        found = top.select(f"n.{group}", "n.index", "n.digest", "a.proof", *(f"a.{c}" for c in passed))
        if known is not None:
            over = F.floor(F.col("n.index") / ARITY) == F.col("a.index")
            lower = here.where("nodes > 1").alias("n").join(known.alias("a"), same_group & over)
            own = F.array(F.struct(F.col("n.before").alias("before"), F.col("n.after").alias("after")))
            found = found.unionByName(lower.select(f"n.{group}", "n.index", "n.digest", F.concat(own, "a.proof").alias("proof"), *(f"a.{c}" for c in passed)))
        known = gathered(found, many)
    return known


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the siblings of its proof give."""
    return F.aggregate(proof, leaf, lambda node, level: digest(level["before"], node, level["after"]))


def manifest(rows: DataFrame, row_id: str, group: str, leaf: Column, claimed: Column) -> DataFrame:
    """``row_id``, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``rows``.

    ``leaf`` is the digest that the tree is built of, and ``claimed`` the one that is held against it:
    folded_root is what ``claimed`` and the siblings of ``leaf`` give, and a row is verified if that is
    the root. Both are expressions over ``rows``.
    """
    slim = rows.select(F.col(row_id).alias("id_"), F.col(group).alias("group_"), leaf.alias("digest"), claimed.alias("claimed_"))
    leaves = materialize(numbered(slim, "group_", ["id_", "digest"]))
    tree = grown(leaves, "group_")
    roots = tops(tree).select(F.lit(0).alias("all_"), F.col("group_").alias("name_"), "digest")
    if tree.bounds[-1] <= FEW:
        order = Window.partitionBy("all_").orderBy("name_")
        subroots = roots.withColumn("index", (F.row_number().over(order) - 1).cast("long")).withColumn("nodes", F.count("*").over(Window.partitionBy("all_")))
    else:
        subroots = numbered(roots, "all_", ["name_"])
    subroots = materialize(subroots)
    upper = grown(subroots, "all_")
    over_all = tops(upper).select("all_", F.expr(EMPTY_PROOF).alias("proof"), F.col("digest").alias("root"))
    placed = with_proofs(upper, over_all).alias("p").join(subroots.alias("s"), "index")
    above = materialize(placed.select(F.col("s.name_").alias("group_"), "p.proof", F.col("p.digest").alias("subroot"), "p.root"))
    proven = with_proofs(tree, above).alias("p").join(
        leaves.alias("l"), F.col("p.group_").eqNullSafe(F.col("l.group_")) & (F.col("p.index") == F.col("l.index"))
    )
    siblings = F.array_join(F.transform("p.proof", lambda level: F.concat(level["before"], level["after"])), "")
    folded = proven.select(
        F.col("l.id_").alias(row_id), F.col("l.digest").alias("leaf"), "p.subroot", "p.root", digest(siblings).alias("proof_sha256"),
        fold(F.col("l.claimed_"), F.col("p.proof")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_leaf(text: Column) -> Column:
    """The leaf of a row of ``documents`` whose text is ``text``."""
    return digest(*(framed(value) for value in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)))


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` by source, held against rows of which every other one lost its line ends.

    Tampered are rows whose decimal doc_id has an even crc32; a null doc_id has none, and its row stays.
    """
    text = F.col("text").cast("string")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    return manifest(docs, "doc_id", "source", document_leaf(text), document_leaf(tampered))
