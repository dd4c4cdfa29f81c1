"""Exact top-k search by inner product: histograms of all scores select each query's kth score.

Vectors are held in slots (candidates) and panels (queries) of bounded size; a tile is one panel
against one slot, and tiles cover all pairs of the stated queries and all rows. A round scores every
tile and counts, for each query, how many scores fall in each of 256 equal bins of the query's
interval, from its highest bin down to where the tile alone has enough. Counts are summed over all tiles, and the
bin with the kth score is the next interval. When bins are one score wide the kth score is known
exactly. A last round keeps what is above it and the ties with the smallest ids, at most k of them
from a tile, and ranks those.

Scores are integers and exact: sums stay below 2 ** 24 in single precision, below 2 ** 53 in double, and are
integers beyond. Scores of 2 ** 62 and more could not be held and raise ValueError.

Vectors that are null or hold a null or non-finite component take no part. Only vectors of equal length
are compared (two empty ones score 0). A row without an id can be found, last among ties, but asks
nothing. Rows are told apart by their place, not by their id: of rows that repeat an id, each is a
query of its own and finds the others. Extra columns are left alone. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_width

SCALE = 64
#: Vectors of a slot and of a panel, on average.
SLOT, PANEL = 16_384, 512
#: Candidates scored at once against a panel.
STRIP = 4_096
#: Bins of a round, as a power of two.
BIN_BITS = 8

PACKED = "part long, dims int, rows array<long>, ids array<long>, matrix binary"
TILE = ["panel", "slot", "dims"]
NOWHERE = -(2**62)


def whole_vectors(rows: DataFrame, row_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """id, row, dims, vec of all rows that take part; row is unique, vec is floor(scale * x) of each component."""
    usable = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vec = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    taken = rows.where(F.coalesce(usable, F.lit(False))).select(F.col(row_id).cast("long").alias("id"), vec.alias("vec"))
    return materialize(taken.select("id", F.monotonically_increasing_id().alias("row"), F.size("vec").alias("dims"), "vec"))


def packed(vectors: DataFrame, parts: int, kind: str) -> DataFrame:
    """One row for each part of ``vectors`` and length: their rows, ids and matrix of numbers of ``kind``."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        lists = [pa.array([table.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("row", "id")]
        fixed = [pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32())]
        return pa.Table.from_arrays([*fixed, *lists, pa.array([flat.astype(kind).tobytes()], pa.binary())], names=["part", "dims", "rows", "ids", "matrix"])

    part = F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part")
    return materialize(vectors.select(part, "dims", "row", "id", "vec").groupBy("part", "dims").applyInArrow(pack, PACKED))


def matrix_of(table: pa.Table, kind: str, number: str) -> np.ndarray:
    """The vectors of a packed row, one in each row of the matrix."""
    rows = len(table.column("rows")[0])
    return np.frombuffer(table.column("matrix")[0].as_py(), kind).reshape(rows, -1).astype(number)


def tile_scores(panel: pa.Table, slot: pa.Table, kind: str, number: str):
    """(first candidate, scores) of strips of a tile; a query's score with its own row is below all others."""
    queries, candidates = matrix_of(panel, kind, number), matrix_of(slot, kind, number)
    asked, held = (np.array(t.column("rows")[0].as_py(), np.int64) for t in (panel, slot))
    _, own_query, own_place = np.intersect1d(asked, held, assume_unique=True, return_indices=True)
    for first in range(0, len(candidates), STRIP):
        scores = (queries @ candidates[first : first + STRIP].T).astype(np.int64)
        inside = (own_place >= first) & (own_place < first + STRIP)
        scores[own_query[inside], own_place[inside] - first] = NOWHERE
        yield first, scores


def intervals(panel: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lowest score, number still needed and whether it is settled, for each query of a panel in order."""
    held = panel.column("interval")[0].as_py()
    return tuple(np.array([x[name] for x in held]) for name in ("low", "need", "settled"))


def counted(panel: pa.Table, slot: pa.Table, bins: int, shift: int, kind: str, number: str) -> pa.Table:
    """place, bin, count of a tile's scores in intervals of ``bins`` bins of ``2 ** shift``.

    For each query no further down than where the tile alone has enough.
    """
    low, need, settled = intervals(panel)
    total = np.zeros(len(low) * bins, np.int64)
    start = (np.arange(len(low)) * bins)[:, None]
    for _, scores in tile_scores(panel, slot, kind, number):
        place = (scores - low[:, None]) >> shift
        total += np.bincount((place + start)[(place >= 0) & (place < bins)], minlength=len(total))
    total = total.reshape(len(low), bins)
    above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total
    query, bin_ = np.nonzero((total > 0) & (above < need[:, None]) & ~settled[:, None])
    return pa.table({"place": query.astype(np.int32), "bin": bin_.astype(np.int32), "count": total[query, bin_]})


def found(panel: pa.Table, slot: pa.Table, kind: str, number: str) -> pa.Table:
    """query, query_id, row, vec_id, score of a tile: all above each query's kth score, and of its ties the smallest ids."""
    low, need, settled = intervals(panel)
    asked, names = (panel.column(c)[0].as_py() for c in ("rows", "ids"))
    rows, ids = (slot.column(c)[0].as_py() for c in ("rows", "ids"))
    order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, rows[i])), np.int64)
    by_id = np.empty(len(ids), np.int64)
    by_id[order] = np.arange(len(ids))
    most = int(need.max())
    out: list[tuple] = []
    ties = np.full((len(asked), most), len(ids), np.int64)  # the smallest places by id so far
    for first, scores in tile_scores(panel, slot, kind, number):
        for query, place in zip(*np.nonzero(scores > np.where(settled, NOWHERE, low)[:, None])):
            out.append((query, first + place, scores[query, place]))
        tied = (scores == low[:, None]) & ~settled[:, None]
        for query in np.flatnonzero(tied.any(axis=1)):
            both = np.concatenate((ties[query], by_id[first : first + STRIP][tied[query]]))
            ties[query] = np.partition(both, most - 1)[:most]
    for query, places in enumerate(ties):
        out += [(query, order[place], low[query]) for place in np.sort(places)[: need[query]] if place < len(ids)]
    columns = zip(*((asked[q], names[q], rows[p], ids[p], int(s)) for q, p, s in out)) if out else [[]] * 5
    return pa.Table.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["query", "query_id", "row", "vec_id", "score"])


def tiles(panels: DataFrame, slots: DataFrame, counts: tuple[int, int], work, schema: str) -> DataFrame:
    """``work`` on every panel and slot of equal length; ``counts`` says how many of either there are."""
    width = min(max(shuffle_width(panels.sparkSession), 1), 2 * counts[0] * counts[1])

    def dealt(side: DataFrame, own: str, other: str, of: int) -> DataFrame:
        rows = side.withColumnRenamed("part", own).withColumn(other, F.explode(F.expr(f"sequence(0L, {of - 1}L)")))
        return rows.repartition(width, *TILE).groupBy(*TILE)

    names = [field.split()[0] for field in schema.split(", ")]

    def both(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:  # no query, or no candidate, of this length
            empty = {"int": pa.int32(), "long": pa.int64()}
            return pa.Table.from_arrays([pa.array([], empty[field.split()[1]]) for field in schema.split(", ")], names=names)
        made = work(left, right)
        if "panel" in names:
            made = made.append_column("panel", pa.array([key[0].as_py()] * len(made), pa.int64())).append_column("dims", pa.array([key[2].as_py()] * len(made), pa.int32()))
        return made.select(names)

    return dealt(panels, "panel", "slot", counts[1]).cogroup(dealt(slots, "slot", "panel", counts[0])).applyInArrow(both, schema)


def narrowed(queries: DataFrame, counts: DataFrame, shift: int) -> DataFrame:
    """Each query's interval after a round: the bin with its kth score, and how many are needed of it.

    A query whose scores are fewer than it needs is settled: all of them are its result.
    """
    key = ["panel", "dims", "place"]
    summed = counts.groupBy(*key, "bin").agg(F.sum("count").alias("count"))
    down = Window.partitionBy(*key).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = summed.withColumn("reached", F.sum("count").over(down)).join(queries, key)
    at = met.where("not settled and reached >= need and reached - count < need")
    chosen = at.select(*key, (F.col("low") + F.shiftleft(F.col("bin").cast("long"), shift)).alias("low_"), (F.col("need") - (F.col("reached") - F.col("count"))).alias("need_"))
    kept = queries.join(chosen, key, "left")
    return kept.select(*key, F.coalesce("low_", "low").alias("low"), F.coalesce("need_", "need").alias("need"), F.col("low_").isNull().alias("settled"))


def nearest_rows(rows: DataFrame, row_id: str, vector: str, asks: Column, k: int, slot_rows: int = SLOT, panel_rows: int = PANEL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of each row that ``asks``, with every row but itself.

    ``asks`` is a condition on ``id``. All if there are fewer than ``k``; ties go to the smaller id.
    """
    vectors = whole_vectors(rows, row_id, vector)
    norm = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    size = vectors.agg(F.count("*"), F.max(norm), F.max(F.aggregate("vec", F.lit(0.0), lambda most, x: F.greatest(most, F.abs(x.cast("double"))))), F.count_if(asks)).first()
    many, asking = size[0], size[3]
    bound = int((size[1] or 0.0) * (1 + 1e-9)) + 1  # no score is larger: a product of two norms
    if bound >= 2**62:
        raise ValueError("scores of these vectors do not fit a long")
    kind = "<i4" if (size[2] or 0.0) < 2**31 else "<i8"
    number = "float32" if bound < 2**24 else "float64" if bound < 2**53 else "int64"
    counts = (max(1, -(-asking // panel_rows)), max(1, -(-many // slot_rows)))
    slots = packed(vectors, counts[1], kind)
    panels = packed(vectors.where(asks), counts[0], kind)
    queries = panels.select(F.col("part").alias("panel"), "dims", F.posexplode("rows").alias("place", "row"))
    queries = queries.select("panel", "dims", "place", F.lit(-bound).cast("long").alias("low"), F.lit(k).cast("long").alias("need"), F.lit(False).alias("settled"))

    def with_intervals() -> DataFrame:
        own = F.array_sort(F.collect_list(F.struct("place", "low", "need", "settled"))).alias("interval")
        each = queries.groupBy(F.col("panel").alias("part"), "dims").agg(own)
        return panels.join(each, ["part", "dims"])

    bits = (2 * bound + 1).bit_length()
    while bits:
        bins, bits = 1 << min(bits, BIN_BITS), max(0, bits - BIN_BITS)
        hist = tiles(with_intervals(), slots, counts, lambda a, b: counted(a, b, bins, bits, kind, number), "panel long, dims int, place int, bin int, count long")
        queries = materialize(narrowed(queries, hist, bits))
    kept = tiles(with_intervals(), slots, counts, lambda a, b: found(a, b, kind, number), "query long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
