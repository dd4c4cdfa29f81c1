"""The registered queries over the generated tables, each beside the SQL that checks it.

A query reads whole tables through the fixtures and applies one operator or a chain of them; what is
rounded is rounded here, at the edge. Queries without SQL are iterative or draw on arrays, and are
checked by the tests.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import colour
from ..functions.geometry import AXES, linear_index
from ..operators import contour, factor, graph, grow, neighbours, resample, sampling, spectrum, spline, stats, store, tours
from ..params import DimensionsParams, SamplerParams, StraightenParams, SvdParams
from ..sources import images, raw_volume, text_files
from ..streaming import heat_stream, reservoir
from . import outputs, programs

Build = Callable[[SparkSession, str], DataFrame]
SHAPE = resample.Shape(fx.DEPTH, fx.HEIGHT, fx.WIDTH)
LAGS, TOP, BEST_WIDTH, PERIOD = 64, 50, 24, 16
EXTRA, OUT_WIDTH = 4, 4
FRAME_KEYS = ["k", "j", "i"]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None = None


CATALOGUE: dict[str, Query] = {}


def register(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def keep(build: Build) -> Build:
        CATALOGUE[name] = Query(build, sql)
        return build

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded, with negative zero made zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# Parts of statements.
VOX = f"vox as ({fx.VOX_SQL})"
STACK = f"stack as ({fx.STACK_SQL})"
SERIES = "series as (select event_id i, value v from events)"
SERIES_P = f"series as (select event_id i, value + case when event_id % {PERIOD} = 0 then 400 else 0 end v from events)"


def sql_hash(*parts: object) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', {', '.join(map(str, parts))})), 1, 4) as int)"


DRAWS = f"""draws as (select d, {sql_hash(fx.SEED, 0, 'd')} % {fx.DEPTH} z, {sql_hash(fx.SEED, 1, 'd')} % {fx.HEIGHT} y,
    {sql_hash(fx.SEED, 2, 'd')} % {fx.WIDTH} x, {sql_hash(fx.SEED, 3, 'd')} u from range({fx.DRAWS}) r(d)),
accepted as (select d, z, y, x, u, v from draws join vox using (z, y, x) where v > u)"""
POINTS = f"""{VOX}, {DRAWS}, points as (select cast(row_number() over (order by d) - 1 as int) idx, z, y, x, v
    from (select * from accepted order by d limit {fx.POINTS}))"""
EDGES = """edges as (select a.idx u, b.idx w, sqrt(pow(a.z - b.z, 2) + pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) d
    from points a join points b on a.idx <> b.idx)"""
PRIM = """prim as (select 0 step, [0] inside, -1 u, 0 w, cast(0 as double) d
    union all select step + 1, list_append(inside, w2), u2, w2, d2 from (
        select step, inside, e.u u2, e.w w2, e.d d2 from prim join edges e
        on list_contains(inside, e.u) and not list_contains(inside, e.w) order by e.d, least(e.u, e.w), greatest(e.u, e.w) limit 1)),
tree as (select u, w, d from prim where u >= 0),
both_ways as (select u a, w b, d from tree union all select w, u, d from tree)"""
SWEEPS = """sweep1 as (select 0 node, -1 prev, cast(0 as double) dist
    union all select b, a, dist + d from sweep1 join both_ways on a = node where b <> prev),
tip1 as (select node from sweep1 order by round(dist, 9) desc, node limit 1),
sweep2 as (select node, -1 prev, cast(0 as double) dist, [node] path from tip1
    union all select b, a, dist + d, list_append(path, b) from sweep2 join both_ways on a = node where b <> prev),
tip2 as (select node, dist, path from sweep2 order by round(dist, 9) desc, node limit 1)"""
CONTROLS = "controls(idx, z, y, x) as (values " + ", ".join(f"({i}, cast({z} as double), cast({y} as double), cast({x} as double))" for i, z, y, x in fx.CONTROLS) + ")"


#: A line with a control for each day of the stack.
LINE = f"""controls as (select cast(row_number() over (order by t) - 1 as int) idx, cast(sum(v) % 61 as double) z, cast(sum(v * (px + 1)) % 67 as double) y, cast(sum(v * (px + 3)) % 71 as double) x
    from stack group by t)"""


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = fx.stack(spark, sf_dir).groupBy("t").agg(
        *((F.sum(F.col("v") * (F.col("px") + more if more else 1)) % size).cast("double").alias(a) for a, more, size in (("z", 0, 61), ("y", 1, 67), ("x", 3, 71)))
    )
    return days.select((F.row_number().over(Window.orderBy("t")) - 1).cast("int").alias("idx"), *AXES)  # one row a day


def distance_sql(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"pow({a}.{c} - {b}.{c}, 2)" for c in AXES) + ")"


def draws(spark: SparkSession) -> DataFrame:
    return sampling.uniform_draws(spark, fx.DRAWS, fx.DEPTH, fx.HEIGHT, fx.WIDTH, fx.SEED)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.bright_points(fx.voxels(spark, sf_dir), draws(spark), fx.POINTS)


def held_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of points as a table of its own, so that what follows does not draw it again."""
    return store.cut_lineage(points(spark, sf_dir))


def bright(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = sampling.bright_sample(fx.voxels(spark, sf_dir), fx.SEED)
    return sample.withColumn("d", linear_index(fx.WIDTH, fx.HEIGHT))


BRIGHT = f"""bright as (select *, cast(z as bigint) * {fx.WIDTH * fx.HEIGHT} + y * {fx.WIDTH} + x d from vox
    where v > {sql_hash(fx.SEED, 'z', 'y', 'x')})"""
NEAREST = f"""assigned as (select d, z, y, x, v, nn from (select p.*, c.idx nn,
    row_number() over (partition by p.d order by {distance_sql('p', 'c')}, c.idx) n from bright p, controls c) where n = 1)"""


@register("vox_profile", f"with {VOX} select count(*) n, min(v) least, max(v) most, cast(sum(v) as bigint) total, cast(count(distinct z) as bigint) depth from vox")
def vox_profile(spark, sf_dir):
    return fx.voxels(spark, sf_dir).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum("v").alias("total"), F.countDistinct("z").alias("depth"))


@register("voxel_linear_id", f"with {VOX} select cast(z as bigint) * 256 + y * 16 + x id, z, y, x, v from vox")
def voxel_linear_id(spark, sf_dir):
    return fx.voxels(spark, sf_dir).select(linear_index(fx.WIDTH, fx.HEIGHT).alias("id"), "z", "y", "x", "v")


# Values have two decimals and their products four, so sums that are rounded to four are the exact ones.
@register("acf_topk", f"""with {SERIES}, n as (select count(*) n from series), lags as (select cast(range as int) lag from range(1, {LAGS + 1}))
select lag, round(sum(a.v * b.v), 4) r from lags, n, series a join series b on b.i = (a.i + lag) % n.n group by lag order by sum(a.v * b.v) desc, lag limit {TOP}""")  # fmt: skip
def acf_topk(spark, sf_dir):
    values = fx.series(spark, sf_dir)
    return rounded(spectrum.top_lags(spectrum.lag_products(values, values.count(), LAGS), TOP), "r", digits=4)


@register("acf_spectrum", f"""with {SERIES}, n as (select count(*) n from series), lags as (select cast(range as int) lag from range(1, {LAGS + 1}))
select lag, round(sum(a.v * b.v), 4) r from lags, n, series a join series b on b.i = (a.i + lag) % n.n group by lag""")  # fmt: skip
def acf_spectrum(spark, sf_dir):
    values = fx.series(spark, sf_dir)
    return rounded(spectrum.autocorrelation(values, values.count(), LAGS), "r", digits=4)


#: The statement sums up only the lags that a candidate can ask for.
SHAPES = f"""with {SERIES_P}, n as (select count(*) n from series),
early as (select lag, sum(a.v * b.v) r from range(1, {BEST_WIDTH + 1}) l(lag), n, series a join series b on b.i = (a.i + lag) % n.n where lag < n.n group by lag),
best as (select cast(lag as int) w from early order by r desc, lag limit 1),
cand as (select w, cast(h.range as int) h from best, n, range(1, 100000) h where w * h.range <= n.n and n.n % (w * h.range) = 0 and h.range < n.n),
late as (select w * h lag, sum(a.v * b.v) r from cand, n, series a join series b on b.i = (a.i + w * h) % n.n where w * h < n.n group by w * h),
found as (select w width, h height, cast(n.n // (w * h) as int) depth, round(r, 4) score from cand cross join n left join late on lag = w * h)"""


@register("shape_candidates", f"{SHAPES} select * from found")
def shape_candidates(spark, sf_dir):
    values = fx.series(spark, sf_dir, PERIOD)
    n = values.count()
    found = spectrum.shape_candidates(spectrum.autocorrelation(values, n, n - 1), n, n, n - 1, BEST_WIDTH)
    return rounded(found, "score", digits=4)


#: A period on a ramp, so that of all its multiples the period itself fits best; in hundredths, whose sums are exact.
RAMP = 2000
INFER = f"""with size as (select count(*) n, least(count(*), {DimensionsParams().fourier_n}) head from events),
series as (select event_id i, cast(round(value * 100) as bigint) + case when event_id % {PERIOD} = 0 then 40000 else 0 end + cast({RAMP} * event_id // n as bigint) * 100 v
    from events, size where event_id < head),
lists as (select list(cast(v as double) order by i) own, list_concat(own, own) twice from series),
acf as (select cast(lag as int) lag, list_dot_product(own, twice[lag + 1:lag + head]) r from range(1, {DimensionsParams().max_dim + 1}) l(lag), size, lists where lag < head),
best as (select lag w from acf order by r desc, lag limit 1),
cand as (select w, cast(h as int) h from best, size, range(1, {DimensionsParams().max_dim + 1}) t(h) where w * h <= n and n % (w * h) = 0)
select w width, h height, cast(n // (w * h) as int) depth, round(cast(r as double) / 10000, 4) score from cand cross join size left join acf on lag = w * h"""


@register("infer_shape", INFER)
def infer_shape(spark, sf_dir):
    events = fx.read(spark, sf_dir, "events")
    n = events.count()
    i = F.col("event_id")
    value = F.col("value") + F.when(i % PERIOD == 0, 400).otherwise(0) + F.floor(RAMP * i / n)
    return rounded(programs.infer_shape(events.select(i.alias("i"), value.alias("v")), n, DimensionsParams()), "score", digits=4)


@register("vox_moments", f"with {VOX} select count(v) n, round(avg(v), 6) mean, round(stddev_samp(v), 6) sd, min(v) least, max(v) most from vox")
def vox_moments(spark, sf_dir):
    return rounded(stats.moments(fx.voxels(spark, sf_dir), "v"), "mean", "sd")


@register("bright_sample", f"with {VOX}, {BRIGHT} select z, y, x, v, d from bright")
def bright_sample(spark, sf_dir):
    return bright(spark, sf_dir)


@register("bright_draws", f"with {POINTS} select * from points")
def bright_draws(spark, sf_dir):
    return points(spark, sf_dir)


#: A draw is a place on the line of all brightness; its voxel is the first whose running sum lies beyond it.
@register("weighted_draws", f"""with {VOX}, ends as (select *, sum(v) over (order by z, y, x) e from vox where v > 0),
drawn as (select d, cast('0x' || substr(md5(concat_ws('|', {fx.SEED}, 7, d)), 1, 15) as bigint) % (select max(e) from ends) r from range({fx.DRAWS}) t(d))
select d, z, y, x, v from drawn join ends on r >= e - v and r < e""")  # fmt: skip
def weighted_draws(spark, sf_dir):
    return sampling.BrightnessIndex(fx.voxels(spark, sf_dir)).draws(0, fx.DRAWS, fx.SEED)


@register("sample_refresh", f"""with {POINTS}, later as (select d, z, y, x, {sql_hash(fx.SEED, 4, 'd')} % {fx.POINTS} idx from
    (select * from accepted where d > (select max(d) from (select d from accepted order by d limit {fx.POINTS})) order by d limit 12)),
written as (select idx, arg_max(z, d) z, arg_max(y, d) y, arg_max(x, d) x from later group by idx)
select cast(idx as int) idx, z, y, x from points where idx not in (select idx from written) union all select cast(idx as int), z, y, x from written""")  # fmt: skip
def sample_refresh(spark, sf_dir):
    voxels = fx.voxels(spark, sf_dir)
    accepted = sampling.accepted_draws(voxels, draws(spark))
    last = accepted.orderBy("d").limit(fx.POINTS).agg(F.max("d")).first()[0]
    return sampling.refreshed_sample(points(spark, sf_dir), accepted.where(F.col("d") > last), 12, fx.POINTS, fx.SEED)


@register("heat_map", f"""with {VOX}, {DRAWS} select cast({fx.HEIGHT // 2 + 1} - floor(y / 2.0) as int) sy, cast(floor(x / 2.0) as int) sx, count(*) hits,
    cast(least(255, 10 * (pow(2.0, least(count(*), 10)) - 1)) as int) heat from accepted group by 1, 2""")  # fmt: skip
def heat_map(spark, sf_dir):
    return programs.sample_heat(spark, fx.voxels(spark, sf_dir), fx.DEPTH, fx.DRAWS, SamplerParams(fx.WIDTH, fx.HEIGHT, 2.0), fx.SEED)


#: Draws of a batch of the streams.
PER_BATCH = 700


def run_to_end(stream: DataFrame, path: str, mode: str, complete: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a stream, batch after batch, until its source has no draws left."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint")
    run = writer.foreachBatch(complete).start() if complete else writer.format("parquet").option("path", path).start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()


@register("heat_stream", f"""with {VOX}, {DRAWS} select cast({fx.HEIGHT // 2 + 1} - floor(y / 2.0) as int) sy, cast(floor(x / 2.0) as int) sx, count(*) hits,
    cast(least(255, 10 * (pow(2.0, least(count(*), 10)) - 1)) as int) heat from accepted group by 1, 2""")  # fmt: skip
def heat_of_stream(spark, sf_dir):
    """The heat map of a stream of draws that stops at ``fx.DRAWS``; each batch writes the screen as it is by then."""
    path, voxels = new_path(spark, "heat"), store.cut_lineage(fx.voxels(spark, sf_dir))  # every batch meets them
    drawn = heat_stream.endless_draws(spark, fx.DEPTH, fx.HEIGHT, fx.WIDTH, fx.SEED, perBatch=PER_BATCH, end=fx.DRAWS)
    heat = heat_stream.heat_stream(drawn, voxels, 2.0, fx.HEIGHT)
    run_to_end(heat, path, "complete", lambda screen, batch: screen.write.mode("overwrite").parquet(path))
    return spark.read.parquet(path)


@register("reservoir_stream", f"""with {POINTS}, later as (select d, z, y, x, {sql_hash(fx.SEED, 4, 'd')} % {fx.POINTS} idx from accepted
    where d > (select max(d) from (select d from accepted order by d limit {fx.POINTS}))),
written as (select idx, arg_max(z, d) z, arg_max(y, d) y, arg_max(x, d) x from later group by idx)
select cast(idx as int) idx, z, y, x from points where idx not in (select idx from written) union all select cast(idx as int), z, y, x from written""")  # fmt: skip
def reservoir_of_stream(spark, sf_dir):
    """The sample of points, renewed by all draws of a stream after those that it was made of."""
    path, voxels = new_path(spark, "reservoir"), store.cut_lineage(fx.voxels(spark, sf_dir))
    sample = store.cut_lineage(sampling.bright_points(voxels, draws(spark), fx.POINTS))
    last = sampling.accepted_draws(voxels, draws(spark)).orderBy("d").limit(fx.POINTS).agg(F.max("d")).first()[0]
    drawn = heat_stream.endless_draws(spark, fx.DEPTH, fx.HEIGHT, fx.WIDTH, fx.SEED, perBatch=PER_BATCH, first=last + 1, end=fx.DRAWS)
    reservoir.prepare(spark)
    changes = reservoir.reservoir_stream(sample, sampling.accepted_draws(voxels, drawn), fx.POINTS, fx.SEED)
    run_to_end(changes, path, "append")
    return reservoir.sample_after(sample, spark.read.schema(reservoir.SLOT).parquet(path))


@register("mid_plane", f"with {VOX} select y, x, v from vox where z = 3 and y % 2 = 0 and x % 2 = 0")
def mid_plane(spark, sf_dir):
    return sampling.plane(fx.voxels(spark, sf_dir), fx.DEPTH // 2, 2)


@register("stack_gram", f"with {STACK} select a.t i, b.t j, cast(sum(a.v * b.v) as bigint) g from stack a join stack b using (px) where a.t <= b.t group by 1, 2")
def stack_gram(spark, sf_dir):
    return factor.sparse_gram(fx.stack(spark, sf_dir))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.stack(spark, sf_dir).select(F.col("px").alias("m"), "t", F.col("v").cast("double").alias("val"))


SIGNALS = f"{STACK}, signals as (select px m, t, cast(v as double) val from stack)"


@register("delayed_corr", f"""with {SIGNALS}, lags as (select cast(range as int) lag from range(0, 4))
select a.m a, b.m b, lag, round(corr(a.val, b.val), 6) r from signals a, lags, signals b where b.t = a.t + lag group by 1, 2, 3 having count(*) > 2""")  # fmt: skip
def delayed_corr(spark, sf_dir):
    millionths = F.signum("r") * F.floor(F.abs("r") * 1e6 + 0.5)  # F.round goes through decimals, which takes longer than all else here
    return stats.all_delayed_correlations(signals(spark, sf_dir), 3, least=3).withColumn("r", millionths / 1e6 + F.lit(0.0))


@register("signal_rescale", f"with {SIGNALS} select m, t, round((val - (select min(val) from signals)) / ((select avg(val) from signals) - (select min(val) from signals)), 6) val from signals")
def signal_rescale(spark, sf_dir):
    return rounded(stats.rescaled_signals(signals(spark, sf_dir)), "val")


@register("pairwise_distance", f"with {POINTS}, {EDGES} select u, w, round(d, 6) d from edges where u < w")
def pairwise_distance(spark, sf_dir):
    return rounded(graph.pairwise_distances(points(spark, sf_dir)), "d")


CENTROIDS = ", ".join(f"round(cast(sum({c}) as double) / count(*), 6) c{c}" for c in AXES)


@register("nearest_centroid", f"with {VOX}, {BRIGHT}, {CONTROLS}, {NEAREST} select nn, count(*) n, count(*) w, {CENTROIDS} from assigned group by nn")
def nearest_centroid(spark, sf_dir):
    found = contour.weighted_centroids(neighbours.nearest(bright(spark, sf_dir), fx.controls(spark)))
    return rounded(found, "cz", "cy", "cx")


@register("weighted_centroid", f"""with {VOX}, {BRIGHT}, {CONTROLS}, {NEAREST} select nn, count(*) n, cast(sum(v) as bigint) w,
    {', '.join(f'round(cast(sum({c} * v) as double) / sum(v), 6) c{c}' for c in AXES)} from assigned group by nn""")  # fmt: skip
def weighted_centroid(spark, sf_dir):
    assigned = neighbours.nearest(bright(spark, sf_dir), fx.controls(spark))
    return rounded(contour.weighted_centroids(assigned, F.col("v")), "cz", "cy", "cx")


@register("nearest_grid", f"with {VOX}, {BRIGHT}, {CONTROLS}, {NEAREST} select d, nn from assigned")
def nearest_grid(spark, sf_dir):
    return neighbours.nearest_by_grid(bright(spark, sf_dir), fx.controls(spark)).select("d", "nn")


@register("mst_edges", f"with recursive {POINTS}, {EDGES}, {PRIM} select least(u, w) u, greatest(u, w) w, round(d, 6) d from tree")
def mst_edges(spark, sf_dir):
    return rounded(graph.minimum_spanning_tree(held_points(spark, sf_dir)), "d")


@register("mst_weight_distributed", f"with recursive {POINTS}, {EDGES}, {PRIM} select count(*) n, round(sum(d), 6) total from tree")
def mst_weight_distributed(spark, sf_dir):
    tree = graph.tree_by_distance(held_points(spark, sf_dir))
    return rounded(tree.agg(F.count("*").alias("n"), F.sum("d").alias("total")), "total")


@register("tree_reach", f"with recursive {POINTS}, {EDGES}, {PRIM}, {SWEEPS} select node, prev, round(dist, 6) dist from sweep1")
def tree_reach(spark, sf_dir):
    return rounded(tours.tree_reach(graph.minimum_spanning_tree(held_points(spark, sf_dir)), 0), "dist")


@register("diameter_ends", f"with recursive {POINTS}, {EDGES}, {PRIM}, {SWEEPS} select tip1.node tip1, tip2.node tip2, round(tip2.dist, 6) length from tip1, tip2")
def diameter_ends(spark, sf_dir):
    first, second, length, _ = tours.diameter(graph.minimum_spanning_tree(held_points(spark, sf_dir)), 0)
    return spark.createDataFrame([(first, second, round(length, 6))], "tip1 int, tip2 int, length double")


@register("backbone", f"""with recursive {POINTS}, {EDGES}, {PRIM}, {SWEEPS},
steps as (select cast(len(path) - generate_subscripts(path, 1) as int) idx, unnest(path) node from tip2)
select s.idx, node, cast(z as double) z, cast(y as double) y, cast(x as double) x from steps s join points p on p.idx = node""")  # fmt: skip
def backbone(spark, sf_dir):
    return graph.backbone(spark, held_points(spark, sf_dir))


@register("neighbour_credit", f"""with {VOX}, {BRIGHT}, {CONTROLS}, {NEAREST}, spread as (select nn + step nn from assigned, (values (-1), (0), (1)) s(step))
select nn, count(*) n from spread where nn between 0 and {len(fx.CONTROLS) - 1} group by nn""")  # fmt: skip
def neighbour_credit(spark, sf_dir):
    assigned = neighbours.nearest(bright(spark, sf_dir), fx.controls(spark))
    return contour.neighbour_credit(assigned, len(fx.CONTROLS)).groupBy("nn").agg(F.count("*").alias("n"))


def stencil_sql(c: str) -> str:
    w = "over (order by idx)"
    m1, p1 = f"lag({c}, 1) {w}", f"lead({c}, 1) {w}"
    return (
        f"coalesce({m1}, 2 * {c} - {p1}) m1{c}, coalesce(lag({c}, 2) {w}, 2 * {m1} - {c}, 3 * {c} - 2 * {p1}) m2{c}, "
        f"coalesce({p1}, 2 * {c} - {m1}) p1{c}, coalesce(lead({c}, 2) {w}, 2 * {p1} - {c}, 3 * {c} - 2 * {m1}) p2{c}"
    )


STENCIL = f"stencil as (select idx, z, y, x, {', '.join(map(stencil_sql, AXES))} from controls)"


@register("contour_stencil", f"with {STACK}, {LINE}, {STENCIL} select * from stencil")
def contour_stencil(spark, sf_dir):
    return contour.curvature_stencil(line(spark, sf_dir))


def step_sql(c: str) -> str:
    p = StraightenParams()
    near, far = f"(m1{c} + p1{c})", f"(m2{c} + p2{c})"
    total = p.alpha + 2 * p.beta + 2 * p.gamma + p.delta
    return f"({p.alpha} * coalesce(c{c}, {c}) + {p.beta} * {near} + {p.gamma} * (1.5 * {near} - 0.5 * {far}) + {p.delta} * {c}) / {total} n{c}"


@register("contour_step", f"""with {VOX}, {BRIGHT}, {CONTROLS}, {NEAREST}, {STENCIL}, centroid as (select nn, {', '.join(f'avg({c}) c{c}' for c in AXES)} from assigned group by nn),
moved as (select idx, z, y, x, {', '.join(map(step_sql, AXES))} from stencil left join centroid on idx = nn)
select idx, round(nz, 6) z, round(ny, 6) y, round(nx, 6) x, round(sqrt(pow(nz - z, 2) + pow(ny - y, 2) + pow(nx - x, 2)), 6) move from moved""")  # fmt: skip
def contour_step(spark, sf_dir):
    return rounded(contour.contour_step(fx.controls(spark), bright(spark, sf_dir), StraightenParams()), *AXES, "move")


@register("stable_runs", f"""with {STACK}, moves as (select t iteration, cast(sum(v) % 300 as double) / 100 move from stack group by t),
marked as (select *, sum(case when move >= 1.55 then 1 else 0 end) over (order by iteration) island from moves)
select iteration, cast(sum(case when move < 1.55 then 1 else 0 end) over (partition by island order by iteration) as bigint) run from marked""")  # fmt: skip
def stable_runs(spark, sf_dir):
    moves = fx.stack(spark, sf_dir).groupBy(F.col("t").alias("iteration")).agg(((F.sum("v") % 300).cast("double") / 100).alias("move"))
    return contour.stable_runs(moves, StraightenParams().move_threshold)


CHORD = f"""stepped as (select *, coalesce(sqrt({' + '.join(f'pow({c} - lag({c}) over (order by idx), 2)' for c in AXES)}), 0) step from controls),
chord as (select idx, z, y, x, sum(step) over (order by idx) s from stepped)"""


@register("chord_length", f"with {STACK}, {LINE}, {CHORD} select idx, z, y, x, round(s, 6) s from chord")
def chord_length(spark, sf_dir):
    return rounded(spline.chord_lengths(line(spark, sf_dir)), "s")


#: Natural spline by elimination forwards and substitution backwards, for all axes at once.
SPLINE = f"""knots as (select axis, idx i, s, val from chord unpivot (val for axis in (z, y, x))),
rows_ as (select b.axis, b.i, b.s - a.s h0, c.s - b.s h1, 6 * ((c.val - b.val) / (c.s - b.s) - (b.val - a.val) / (b.s - a.s)) r
    from knots b join knots a on a.axis = b.axis and a.i = b.i - 1 join knots c on c.axis = b.axis and c.i = b.i + 1),
forward as (select axis, i, h1 / (2 * (h0 + h1)) cp, r / (2 * (h0 + h1)) dp from rows_ where i = 1
    union all select n.axis, n.i, n.h1 / (2 * (n.h0 + n.h1) - n.h0 * f.cp), (n.r - n.h0 * f.dp) / (2 * (n.h0 + n.h1) - n.h0 * f.cp)
    from forward f join rows_ n on n.axis = f.axis and n.i = f.i + 1),
backward as (select axis, max(i) i, cast(0 as double) m from knots group by axis
    union all select f.axis, f.i, f.dp - f.cp * b.m from backward b join forward f on f.axis = b.axis and f.i = b.i - 1),
second as (select axis, i, m from backward union all select axis, 0, 0 from (select distinct axis from knots)),
spline as (select a.axis, a.i, a.s s0, b.s s1, a.val a, (b.val - a.val) / (b.s - a.s) - (b.s - a.s) * (2 * ma.m + mb.m) / 6 b, ma.m / 2 c,
    (mb.m - ma.m) / (6 * (b.s - a.s)) d from knots a join knots b on b.axis = a.axis and b.i = a.i + 1
    join second ma on ma.axis = a.axis and ma.i = a.i join second mb on mb.axis = a.axis and mb.i = a.i + 1)"""


def control_spline() -> spline.Spline:
    return spline.natural_spline(np.array([c[1:] for c in fx.CONTROLS]))


def day_spline(spark: SparkSession, sf_dir: str) -> spline.Spline:
    return spline.natural_spline(np.array([[r[a] for a in AXES] for r in line(spark, sf_dir).orderBy("idx").collect()]))  # one row a day


@register("spline_coeffs", f"with recursive {STACK}, {LINE}, {CHORD}, {SPLINE} select axis, i, {', '.join(f'round({k}, 6) + 0.0 {k}' for k in ('s0', 's1', 'a', 'b', 'c', 'd'))} from spline")
def spline_coeffs(spark, sf_dir):
    return rounded(spline.spline_table(spark, day_spline(spark, sf_dir)), "s0", "s1", "a", "b", "c", "d")


def line_output() -> resample.OutputShape:
    params = StraightenParams(out_width=OUT_WIDTH, out_extra=EXTRA)
    return resample.output_shape(SHAPE, control_spline().length, params)


def line_frames(spark: SparkSession, curve: spline.Spline | None = None) -> DataFrame:
    curve = curve or control_spline()
    rows = spark.range(int(curve.length) + 2 * EXTRA).select(F.col("id").cast("int").alias("j"), (F.col("id") - EXTRA).cast("double").alias("s"))
    return spline.spline_frames(rows, spline.spline_table(spark, curve))


FRAMES = f"""size as (select cast(floor(max(s1)) as int) + 2 * {EXTRA} h, max(s1) len from spline),
place as (select cast(range as int) j, cast(range as double) - {EXTRA} s, least(greatest(cast(range as double) - {EXTRA}, 0), len) c from size, range(0, 100000) where range < h),
evaluated as (select j, axis, a + t * (b + t * (c_ + t * d)) + over_ * (b + t * (2 * c_ + t * 3 * d)) p, b + t * (2 * c_ + t * 3 * d) slope from
    (select j, axis, a, b, spline.c c_, d, place.c - s0 t, s - place.c over_ from place, size join spline on place.c >= s0 and (place.c < s1 or (place.c = len and s1 = len)))),
wide as (select j, {', '.join(f"max(case when axis = '{c}' then p end) p{c}, max(case when axis = '{c}' then slope end) d{c}" for c in AXES)} from evaluated group by j),
across as (select *, dx / sqrt(dx * dx + dy * dy) uy, -dy / sqrt(dx * dx + dy * dy) ux from wide),
raised as (select *, uy * dx - ux * dy rz, ux * dz ry, -uy * dz rx from across),
frames as (select j, pz, py, px, 0.0 uz, uy, ux, {', '.join(f'r{c} / sqrt(rz * rz + ry * ry + rx * rx) n{c}' for c in AXES)} from raised)"""
FRAME_COLUMNS = [f"{k}{c}" for k in "pun" for c in AXES]


@register("spline_frames", f"with recursive {STACK}, {LINE}, {CHORD}, {SPLINE}, {FRAMES} select j, {', '.join(f'round(cast({c} as double), 6) + 0.0 {c}' for c in FRAME_COLUMNS)} from frames")
def spline_frames(spark, sf_dir):
    return rounded(line_frames(spark, day_spline(spark, sf_dir)), *FRAME_COLUMNS)


def gather_sql(points_cte: str) -> str:
    """Trilinear values of ``points_cte`` (k, j, i, z, y, x)."""
    sizes = dict(SHAPE.sizes)
    bounds = " and ".join(f"floor({c}) >= 0 and floor({c}) < {sizes[c] - 1}" for c in AXES)
    weight = " * ".join(f"case when c{c} = 0 then 1 - ({c} - floor({c})) else {c} - floor({c}) end" for c in AXES)
    places = " and ".join(f"vox.{c} = cast(floor(p.{c}) as int) + c{c}" for c in AXES)
    return f"""corner as (select * from (values (0), (1)) a(cz), (values (0), (1)) b(cy), (values (0), (1)) c(cx)),
summed as (select k, j, i, sum(({weight.replace('floor(', 'floor(p.').replace('({', '({').replace('1 - (', '1 - (p.').replace('else ', 'else p.')}) * vox.v) val
    from {points_cte} p, corner join vox on {places} where {bounds.replace('floor(', 'floor(p.')} group by k, j, i)
select k, j, i, round(coalesce(val, 0), 4) val from {points_cte} left join summed using (k, j, i)"""


GRID = """grid as (select 0 k, cast(j.range as int) j, cast(i.range as int) i, 0.31e0 * j.range + 0.5e0 z,
    1.07e0 * j.range + 1.25e0 - 0.2e0 * i.range y, 0.9e0 * j.range - 1 + 1.3e0 * i.range x from range(0, 12) j(range), range(0, 6) i(range))"""


def tilted_grid(spark: SparkSession) -> DataFrame:
    cells = spark.range(72).select(F.lit(0).alias("k"), F.floor(F.col("id") / 6).cast("int").alias("j"), (F.col("id") % 6).cast("int").alias("i"))
    j, i = F.col("j"), F.col("i")
    return cells.select("k", "j", "i", (0.31 * j + 0.5).alias("z"), (1.07 * j + 1.25 - 0.2 * i).alias("y"), (0.9 * j - 1 + 1.3 * i).alias("x"))


@register("trilinear", f"with {VOX}, {GRID}, {gather_sql('grid')}")
def trilinear(spark, sf_dir):
    return rounded(resample.trilinear(tilted_grid(spark), fx.voxels(spark, sf_dir), SHAPE, FRAME_KEYS), "val", digits=4)


@register("nearest_gather", f"""with {VOX}, {GRID} select k, j, i, coalesce(cast(v as double), 0) val from grid
    left join vox on vox.z = cast(round_even(grid.z, 0) as int) and vox.y = cast(round_even(grid.y, 0) as int) and vox.x = cast(round_even(grid.x, 0) as int)""")  # fmt: skip
def nearest_gather(spark, sf_dir):
    return resample.nearest_voxel(tilted_grid(spark), fx.voxels(spark, sf_dir), SHAPE, FRAME_KEYS)


STRAIGHT = f"""places as (select cast(k.range as int) k, f.j, cast(i.range as int) i,
    {', '.join(f'p{c} + (k.range - {(fx.DEPTH // 2 - 1) * 2 / 2}) * n{c} + (i.range - {OUT_WIDTH / 2}) * u{c} {c}' for c in AXES)}
    from frames f, range(0, {(fx.DEPTH // 2 - 1) * 2}) k(range), range(0, {OUT_WIDTH}) i(range))"""


@register("straight_resample", f"with recursive {VOX}, {CONTROLS}, {CHORD}, {SPLINE}, {FRAMES}, {STRAIGHT}, {gather_sql('places')}")
def straight_resample(spark, sf_dir):
    places = resample.sample_points(line_frames(spark), line_output(), fx.DEPTH)
    return rounded(resample.trilinear(places, fx.voxels(spark, sf_dir), SHAPE, FRAME_KEYS), "val", digits=4)


@register("straighten_program")
def straighten_program(spark, sf_dir):
    params = StraightenParams(out_width=OUT_WIDTH, out_extra=EXTRA)
    return programs.straighten(spark, fx.voxels(spark, sf_dir), SHAPE, params).volume


@register("svd_energy", f"with {STACK} select round(cast(sum(v * v) as double) / 1000000, 2) energy from stack")
def svd_energy(spark, sf_dir):
    svd = factor.truncated_svd(fx.stack(spark, sf_dir), fx.DAYS, fx.DAYS)
    return rounded(svd.s.agg((F.sum(F.col("val") * F.col("val")) / 1000000).alias("energy")), "energy", digits=2)


@register("full_rank_reconstruction", f"""with {STACK} select cast(px as bigint) "row", t, cast(v as double) val from stack where v <> 0""")
def full_rank_reconstruction(spark, sf_dir):
    full = factor.reconstruct(factor.truncated_svd(fx.stack(spark, sf_dir), fx.DAYS, fx.DAYS))
    return rounded(full, "val", digits=3).where("val <> 0")


SWEEPS_OF_TURNS = 10 * (fx.DAYS - 1)
#: Factors of the stack by turning pairs of columns of its Gram matrix until they stand upright on each other (one-sided
#: Jacobi, every pair once in DAYS - 1 steps): modes (k, s, v), vt (k, t, val), u ("row", k, val).
FACTORS = f"""pairs as (select a.t i, b.t j, cast(sum(a.v * b.v) as double) g from stack a join stack b using (px) group by 1, 2),
turns as (select 0 step, cast(i.range as int) i, list(coalesce(g, 0) order by j.range) w
        from range({fx.DAYS}) i(range) cross join range({fx.DAYS}) j(range) left join pairs on pairs.i = i.range and pairs.j = j.range group by 1, 2
    union all select step + 1, i, list_transform(list_zip(w, o), lambda e: (e[1] - e[2] * tangent) / sqrt(1 + tangent * tangent)) from (
        select *, case when across = 0 then 0 when ratio > 0 or ratio = 0 and i < j then 1 / (ratio + sqrt(1 + ratio * ratio)) else -1 / (sqrt(1 + ratio * ratio) - ratio) end tangent from (
        select *, case when across = 0 then 0 else (list_dot_product(o, o) - list_dot_product(w, w)) / (2 * across) end ratio from (
        select a.step, a.i, b.i j, a.w, b.w o, list_dot_product(a.w, b.w) across from turns a join turns b
        on b.i = case when a.i = {fx.DAYS - 1} then a.step * {fx.DAYS // 2} % {fx.DAYS - 1} when 2 * a.i % {fx.DAYS - 1} = a.step % {fx.DAYS - 1} then {fx.DAYS - 1}
            else (a.step + {fx.DAYS - 1} - a.i) % {fx.DAYS - 1} end
        where a.step < {SWEEPS_OF_TURNS})))),
upright as (select sqrt(list_dot_product(w, w)) square, case when list_max(w) < -list_min(w) then -1 else 1 end sign, w from turns where step = {SWEEPS_OF_TURNS}),
modes as (select cast(row_number() over (order by square desc) - 1 as int) k, sqrt(square) s, list_transform(w, lambda e: e * sign / square) v from upright
    where square > 1e-12 * (select max(square) from upright)),
vt as (select k, cast(t.range as int) t, v[t.range + 1] val from modes, range({fx.DAYS}) t(range)),
u as (select cast(px as bigint) "row", vt.k, sum(stack.v * vt.val) / any_value(modes.s) val from stack join vt using (t) join modes on modes.k = vt.k group by 1, 2)"""
TRACED, TRACE_COLOURS, KEPT_RANK = 3, 10, 5


@register("rank_recon_error", f"""with recursive {STACK}, {FACTORS}, rebuilt as (select u."row", vt.t, sum(u.val * s * vt.val) val
    from u join vt using (k) join modes using (k) where k < {KEPT_RANK} group by 1, 2),
errors as (select sum(pow(coalesce(val, 0) - coalesce(v, 0), 2)) error from rebuilt full join stack on px = "row" and stack.t = rebuilt.t)
select round(error / 1000000, 4) error, round((select cast(sum(v * v) as double) from stack) / 1000000, 4) energy,
    round((select sum(s * s) from modes where k < {KEPT_RANK}) / 1000000, 4) kept from errors""")  # fmt: skip
def rank_recon_error(spark, sf_dir):
    px = fx.stack(spark, sf_dir)
    svd = factor.truncated_svd(px, fx.DAYS, KEPT_RANK)
    cells = px.select(F.col("px").cast("long").alias("row"), "t", F.col("v").cast("double").alias("v"))
    joined = factor.reconstruct(svd).join(cells, ["row", "t"], "full")
    gap = F.coalesce("val", F.lit(0.0)) - F.coalesce("v", F.lit(0.0))
    both = joined.agg((F.sum(gap * gap) / 1000000).alias("error"), (F.sum(F.pow(F.coalesce("v", F.lit(0.0)), 2)) / 1000000).alias("energy"))
    kept = svd.s.agg((F.sum(F.col("val") * F.col("val")) / 1000000).alias("kept"))
    return rounded(both.join(F.broadcast(kept)), "error", "energy", "kept", digits=4)


@register("seed_trace", f"""with recursive {STACK}, {FACTORS} select vt.t, round(sum(u.val * s * vt.val), 4) val from u join vt using (k) join modes using (k)
    where "row" = {TRACED} and k between 1 and {TRACE_COLOURS - 1} group by 1""")  # fmt: skip
def seed_trace(spark, sf_dir):
    svd = factor.truncated_svd(fx.stack(spark, sf_dir), fx.DAYS, TRACE_COLOURS)
    return rounded(factor.seed_trace(svd, TRACED, TRACE_COLOURS), "val", digits=4)


CELL_COLOURS = 8


def unit_sql(i: int) -> str:
    """A draw from between 0 and 1 for a component."""
    return f"(({sql_hash(fx.SEED, i, 'k')} + 0.5) / 65536.0)"


def cell_params(px: DataFrame) -> SvdParams:
    """Parameters for a stack whose plane is as high as its pixels ask for."""
    height = int(px.agg(F.max("px")).first()[0]) // fx.STACK_WIDTH + 1
    return SvdParams(fx.STACK_WIDTH, height, dim=20, colors=CELL_COLOURS, masks=6, scale=20.0, threshold=0.2, seed=fx.SEED)


def cells(spark: SparkSession, sf_dir: str) -> programs.Cells:
    px = fx.stack(spark, sf_dir)
    return programs.find_cells(spark, px, fx.DAYS, cell_params(px))


@register("cell_masks")
def cell_masks(spark, sf_dir):
    return cells(spark, sf_dir).masks.mask


@register("cell_frames")
def cell_frames(spark, sf_dir):
    return cells(spark, sf_dir).frames


@register("pixel_colours", f"""with recursive {STACK}, {FACTORS}, sums as (select "row", sum(abs(val * s)) size, sum(val * s * (2 * {unit_sql(0)} - 1)) sx, sum(val * s * (2 * {unit_sql(1)} - 1)) sy
    from u join modes using (k) where k between 1 and {CELL_COLOURS - 1} group by 1),
one as (select avg(size) + 3 * coalesce(stddev_samp(size), 0) scale from sums)
select "row", round(case when sx = 0 and sy = 0 then 0 else atan2(sy, sx) / 6.283185307179586 + 0.5 end, 6) hue,
    round(case when scale > 0 then least(size / scale, 0.999) else 0 end, 6) saturation from sums, one""")  # fmt: skip
def pixel_colours(spark, sf_dir):
    return rounded(cells(spark, sf_dir).pixel_colours, "hue", "saturation")


@register("component_shapes", f"""with recursive {STACK}, {FACTORS}, drawn as (select k, {unit_sql(0)} r, {unit_sql(1)} g, {unit_sql(2)} b from modes where k > 0),
palette as (select k, r * 0.02 / (0.33 * (r + g + b)) r, g * 0.02 / (0.33 * (r + g + b)) g, b * 0.02 / (0.33 * (r + g + b)) b from drawn),
mixed as (select "row", {', '.join(f'sum(val * s / {50 * CELL_COLOURS} * {c}) + 0.33 {c}' for c in 'rgb')} from u join modes using (k) join palette using (k)
    where k < {CELL_COLOURS} group by 1),
strong as (select *, sqrt(greatest((r * r + g * g + b * b) / 3 - pow((r + g + b) / 3, 2), 0)) * {CELL_COLOURS} sd from mixed)
select "row", {', '.join(f'cast(floor(least(greatest({c} * sd, 0), 1) * 255) as int) {c}' for c in 'rgb')} from strong""")  # fmt: skip
def component_shapes(spark, sf_dir):
    px = fx.stack(spark, sf_dir)
    return programs.colour_shapes(px, fx.DAYS, cell_params(px))[1]


@register("component_stack", f"""with recursive {STACK}, {FACTORS} select "row", k, cast(floor(least(greatest(val * s, 0), 65535)) as int) v from u join modes using (k) where k < {KEPT_RANK}""")
def component_stack(spark, sf_dir):
    return outputs.component_stack(factor.truncated_svd(fx.stack(spark, sf_dir), fx.DAYS, KEPT_RANK))


@register("region_grow", f"""with recursive {VOX}, median_ as (select avg(v) level from vox where z = 3), field as (select y, x from vox, median_ where z = 3 and v > 0.9 * level),
first_ as (select y, x from field order by y, x limit 1),
flood as (select f.y, f.x from field f, first_ s where abs(f.y - s.y) + abs(f.x - s.x) = 1
    union select f.y, f.x from flood p, field f where abs(f.y - p.y) + abs(f.x - p.x) = 1)
select y, x from flood""")  # fmt: skip
def region_grow(spark, sf_dir):
    plane = store.cut_lineage(fx.voxels(spark, sf_dir).where("z = 3").select("y", "x", "v"))
    level = plane.agg(F.avg("v")).first()[0]
    accept = F.col("v") > 0.9 * level
    return grow.flood(plane, plane.where(accept).orderBy("y", "x").limit(1), accept)


MASKS = f"{VOX}, masks as (select z m, y, x, cast(v as double) / 65536 val from vox where v > 15000)"


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.voxels(spark, sf_dir).where("v > 15000").select(F.col("z").alias("m"), "y", "x", (F.col("v").cast("double") / 65536).alias("val"))


@register("mask_bbox", f"with {MASKS} select m, min(x) xmin, max(x) xmax, min(y) ymin, max(y) ymax from masks group by m")
def mask_bbox(spark, sf_dir):
    return grow.bounding_boxes(masks(spark, sf_dir))


@register("mask_peak_norm", f"with {MASKS} select m, y, x, round(val / max(val) over (partition by m), 6) val from masks")
def mask_peak_norm(spark, sf_dir):
    return rounded(stats.peak_normalised(masks(spark, sf_dir)), "val")


ALL_CELLS = fx.DEPTH * fx.HEIGHT * fx.WIDTH


@register("mask_rescale", f"""with {MASKS}, one as (select max(val) - sqrt((sum(val * val) - sum(val) * sum(val) / {ALL_CELLS}) / {ALL_CELLS - 1}) scale, least(min(val), 0) low from masks),
mapped as (select m, y, x, (val - low) / (scale - low) val from masks, one) select m, y, x, round(val / max(val) over (partition by m), 6) val from mapped""")  # fmt: skip
def mask_rescale(spark, sf_dir):
    return rounded(stats.rescaled_masks(masks(spark, sf_dir), ALL_CELLS), "val")


@register("embedding_similarity", """with seed as (select cast(embedding as double[]) s from embeddings where vec_id = 0)
select vec_id, round(list_dot_product(cast(embedding as double[]), s), 6) dot from embeddings, seed
where list_dot_product(cast(embedding as double[]), s) > 0.1""")  # fmt: skip
def embedding_similarity(spark, sf_dir):
    vectors = fx.read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("e"))
    seed = vectors.where("vec_id = 0").select(F.col("e").alias("s"))
    dot = F.aggregate(F.zip_with("e", "s", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return rounded(vectors.join(F.broadcast(seed)).select("vec_id", dot.alias("dot")).where("dot > 0.1"), "dot")


#: Cells of the stack as colours: hue by pixel, saturation by day, lightness by value.
CELLS3 = f"{STACK}, g as (select px, t, (px % 9) / 8.0e0 c, (t % 9) / 8.0e0 s, least(v / 4000.0e0, 1) l from stack)"


def colour_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, t = F.col("px"), F.col("t")
    return fx.stack(spark, sf_dir).select("px", "t", ((px % 9) / 8.0).alias("c"), ((t % 9) / 8.0).alias("s"), F.least(F.col("v") / 4000.0, F.lit(1.0)).alias("l"))


def inverse_sql(t: str) -> str:
    return f"case when {t} > 6.0e0 / 29 then ({t}) * ({t}) * ({t}) else (({t}) - 4.0e0 / 29) * (3 * (6.0e0 / 29) * (6.0e0 / 29)) end"


def xyz_sql(light: str, a: str, b: str) -> list[str]:
    middle = f"(({light} + 0.16e0) / 1.16e0)"
    return [f"({inverse_sql(t)}) * {white}" for t, white in zip((f"{middle} + {a} / 5.0e0", middle, f"{middle} - {b} / 2.0e0"), ("0.9643e0", "1.0e0", "0.8251e0"), strict=True)]


def byte_sql(row: tuple[float, ...]) -> str:
    linear = f"({row[0]}e0 * cx + {row[1]}e0 * cy + {row[2]}e0 * cz)"
    return f"""cast(floor(255.0e0 * (case when {linear} < 0.001e0 then 0 when {linear} > 0.999e0 then 1 when {linear} <= 0.0031308e0 then {linear} * 12.92e0
        else pow(greatest({linear}, 0), 1.0e0 / 2.4e0) * 1.055e0 - 0.055e0 end)) as int)"""


RGB = ", ".join(f"{byte_sql(row)} {name}" for row, name in zip(colour.TO_RGB, "rgb", strict=True))
ANGLE = f"({colour.TAU / 6}e0 - c * {colour.TAU}e0)"
XYZ = [f"({part})" for part in xyz_sql("light", "a", "b")]


def rgb_sql(lab: str) -> str:
    return f"lab as ({lab}), xyz as (select *, {', '.join(f'{part} {n}' for part, n in zip(XYZ, ('cx', 'cy', 'cz'), strict=True))} from lab)"


def with_rgb(df: DataFrame, channels: list) -> DataFrame:
    return df.select("*", *(c.alias(n) for c, n in zip(channels, "rgb", strict=True)))


@register("csl_to_rgb", f"with {CELLS3}, {rgb_sql(f'select px, t, c, s, l, l * 0.7e0 light, sin({ANGLE}) * (s * 0.426e0) a, cos({ANGLE}) * (s * 0.426e0) b from g')} select px, t, c, s, l, {RGB} from xyz")
def csl_to_rgb(spark, sf_dir):
    return with_rgb(colour_cells(spark, sf_dir), colour.csl_to_rgb(F.col("c"), F.col("s"), F.col("l")))


@register("cl_to_rgb", f"with {CELLS3}, {rgb_sql(f'select px, t, c, l, l * 0.7e0 light, sin({ANGLE}) * (l * 0.301e0 + 0.125e0) a, cos({ANGLE}) * (l * 0.301e0 + 0.125e0) b from g')} select px, t, c, l, {RGB} from xyz")
def cl_to_rgb(spark, sf_dir):
    return with_rgb(colour_cells(spark, sf_dir).select("px", "t", "c", "l"), colour.cl_to_rgb(F.col("c"), F.col("l")))


@register("lab_to_xyz", f"with {CELLS3}, {rgb_sql('select px, t, c, s, l, c light, s - 0.5e0 a, l - 0.5e0 b from g')} select px, t, c, s, l, round(cx, 6) + 0.0 cx, round(cy, 6) + 0.0 cy, round(cz, 6) + 0.0 cz from xyz")
def lab_to_xyz(spark, sf_dir):
    xyz = colour.lab_to_xyz(F.col("c"), F.col("s") - 0.5, F.col("l") - 0.5)
    return rounded(colour_cells(spark, sf_dir).select("*", *(p.alias(n) for p, n in zip(xyz, ("cx", "cy", "cz"), strict=True))), "cx", "cy", "cz")


def hsv_sql(shift: int) -> str:
    k = f"((c * 6 + {shift}) - 6 * floor((c * 6 + {shift}) / 6))"
    return f"cast(floor((l - l * s * greatest(0, least({k}, 4 - {k}, 1))) * 255.0e0) as int)"


@register("hsv_to_rgb", f"with {CELLS3} select px, t, c, s, l, {hsv_sql(5)} r, {hsv_sql(3)} g, {hsv_sql(1)} b from g")
def hsv_to_rgb(spark, sf_dir):
    return with_rgb(colour_cells(spark, sf_dir), colour.hsv_to_rgb(F.col("c"), F.col("s"), F.col("l")))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.stack(spark, sf_dir).groupBy((F.col("px") % 5).alias("m"), (F.col("t") % 6).alias("k")).agg((F.sum("v") / 1000.0).cast("double").alias("val"))


@register("component_colour", f"""with {STACK}, w as (select px % 5 m, t % 6 k, cast(sum(v) as double) / 1000 val from stack group by 1, 2),
dirs as (select k, 2 * ({sql_hash(fx.SEED, 0, 'k')} + 0.5e0) / 65536.0e0 - 1 dx, 2 * ({sql_hash(fx.SEED, 1, 'k')} + 0.5e0) / 65536.0e0 - 1 dy from (select distinct k from w))
select m, round(atan2(sum(val * dy), sum(val * dx)) / {colour.TAU}e0 + 0.5e0, 6) hue, round(sum(abs(val)), 6) saturation from w join dirs using (k) group by m""")  # fmt: skip
def component_colour(spark, sf_dir):
    own = weights(spark, sf_dir)
    return rounded(stats.component_colours(own, stats.component_directions(own, fx.SEED), "m"), "hue", "saturation")


@register("palette", f"""with {STACK}, k as (select distinct px + 1 k from stack), drawn as (select k, {', '.join(f"({sql_hash(fx.SEED, i, 'k')} + 0.5e0) / 65536.0e0 {n}" for i, n in enumerate('rgb'))} from k)
select k, {', '.join(f'round({n} * (0.02e0 / (0.33e0 * r + 0.33e0 * g + 0.33e0 * b)), 6) {n}' for n in 'rgb')} from drawn""")  # fmt: skip
def palette(spark, sf_dir):
    return rounded(stats.palette(fx.stack(spark, sf_dir).select((F.col("px") + 1).alias("k")), fx.SEED), "r", "g", "b")


@register("additive_blend", f"""with {MASKS}, {STACK}, sig as (select px % {fx.DEPTH} m, t, avg(cast(v as double)) / 3000 light from stack group by 1, 2),
lit as (select t, y, x, m / 7.0e0 c, 0.5e0 s, light * val l from masks join sig using (m)),
{rgb_sql(f'select t, y, x, l * 0.7e0 light, sin({ANGLE}) * (s * 0.426e0) a, cos({ANGLE}) * (s * 0.426e0) b from lit')},
added as (select t, y, x, sum(cx) cx, sum(cy) cy, sum(cz) cz from xyz group by 1, 2, 3) select t, y, x, {RGB} from added""")  # fmt: skip
def additive_blend(spark, sf_dir):
    own = fx.stack(spark, sf_dir).groupBy((F.col("px") % fx.DEPTH).alias("m"), "t").agg((F.avg(F.col("v").cast("double")) / 3000).alias("val"))  # each trace lights one mask
    colours = spark.range(fx.DEPTH).select(F.col("id").cast("int").alias("m"), (F.col("id") / 7.0).alias("hue"), F.lit(0.5).alias("saturation"))
    return stats.additive_blend(masks(spark, sf_dir), own, colours)


@register("coloured_stack", f"""with {STACK}, size as (select cast(max(px) // {fx.STACK_WIDTH} + 1 as bigint) * {fx.STACK_WIDTH} n from stack),
dense as (select cast(t.range as int) z, p.range row_, coalesce(v, 0) v from size, range(0, {fx.DAYS}) t(range), range(0, 1000000) p(range) left join stack on stack.px = p.range and stack.t = t.range where p.range < size.n),
white as (select avg(v) + 3 * stddev_samp(v) white from dense),
lit as (select z, cast(row_ // {fx.STACK_WIDTH} as int) y, cast(row_ % {fx.STACK_WIDTH} as int) x, (row_ % 7) / 7.0e0 c, (row_ % 5) / 5.0e0 s, least(greatest(v / white, 0), 1) l from dense, white),
{rgb_sql(f'select z, y, x, l * 0.7e0 light, sin({ANGLE}) * (s * 0.426e0) a, cos({ANGLE}) * (s * 0.426e0) b from lit')} select z, y, x, {RGB} from xyz""")  # fmt: skip
def coloured_stack(spark, sf_dir):
    px = fx.stack(spark, sf_dir)
    dense = outputs.dense_stack(px, fx.DAYS, cell_params(px))
    row = F.col("row")
    colours = dense.where("z = 0").select("row", ((row % 7) / 7.0).alias("hue"), ((row % 5) / 5.0).alias("saturation"))
    return outputs.coloured_stack(dense, colours, fx.STACK_WIDTH)


@register("spline_tsv", f"with {STACK}, {LINE} select idx, printf('%.10f', z) || chr(9) || printf('%.10f', y) || chr(9) || printf('%.10f', x) line from controls")
def spline_tsv(spark, sf_dir):
    return text_files.control_lines(line(spark, sf_dir))


@register("bbox_json", f"""with {MASKS}, boxes as (select m, min(x) xmin, max(x) xmax, min(y) ymin, max(y) ymax from masks group by m)
select m, cast(to_json({{'xmin': xmin, 'xmax': xmax, 'ymin': ymin, 'ymax': ymax}}) as varchar) json from boxes""")  # fmt: skip
def bbox_json(spark, sf_dir):
    return text_files.box_json(grow.bounding_boxes(masks(spark, sf_dir)))


def new_path(spark: SparkSession, name: str) -> str:
    """A new path among what the cluster shares."""
    return f"{store.shared_folder(spark)}/voxmill-{uuid.uuid4().hex}/{name}"


@register("raw_roundtrip", f"""with {VOX} select cast(z.range as int) z, cast(y.range as int) y, cast(x.range as int) x, coalesce(v, 0) v
    from range(0, {fx.DEPTH}) z(range), range(0, {fx.HEIGHT}) y(range), range(0, {fx.WIDTH}) x(range)
    left join vox on vox.z = z.range and vox.y = y.range and vox.x = x.range""")  # fmt: skip
def raw_roundtrip(spark, sf_dir):
    path = new_path(spark, "volume.raw")
    raw_volume.write_raw(fx.voxels(spark, sf_dir), path, fx.DEPTH, fx.HEIGHT, fx.WIDTH)
    raw_volume.register(spark)
    return spark.read.format("rawvol").options(width=fx.WIDTH, height=fx.HEIGHT, planesPerPartition=2).load(path)


@register("plane_images")
def plane_images(spark, sf_dir):
    return images.images(images.grey_planes(fx.voxels(spark, sf_dir)), "z", fx.HEIGHT, fx.WIDTH)

