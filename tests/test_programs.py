"""Masks, traces, colours, contours and large trees against slow forms, and the files that programs write."""

import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill import fixtures as fx
from voxmill.operators import contour, factor, graph, grow, neighbours, resample, stats, tours
from voxmill.params import StraightenParams, SvdParams
from voxmill.plans import catalogue, outputs, programs
from voxmill.sources import raw_volume, text_files

SF_DIR = "/root/testdata/sf0.01"


def draw(digits, *parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:digits], 16)


def decoded(png):
    """Pixels of an 8-bit PNG without row filters."""
    width, height, depth, kind = struct.unpack(">IIBB", png[16:26])
    data, at = b"", 8
    while at < len(png):
        (size,) = struct.unpack(">I", png[at : at + 4])
        data += png[at + 8 : at + 8 + size] if png[at + 4 : at + 8] == b"IDAT" else b""
        at += 12 + size
    channels = {0: 1, 2: 3}[kind]
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * channels)
    assert depth == 8 and not rows[:, 0].any()
    return rows[:, 1:].reshape(height, width, channels)


@pytest.fixture(scope="module")
def stack(spark):
    px = fx.stack(spark, SF_DIR).cache()
    return px, catalogue.cell_params(px)


@pytest.fixture(scope="module")
def cells(spark, stack):
    return programs.find_cells(spark, stack[0], fx.DAYS, stack[1])


def dense(px, params):
    matrix = np.zeros((params.width * params.height, fx.DAYS))
    for row in px.collect():
        matrix[row["px"], row["t"]] = row["v"]
    return matrix


def slow_masks(load, params):
    """Masks one pixel at a time: (m, y, x) -> value, and seeds."""
    pixels, owned, masks, seeds, d = len(load), set(), {}, [], -1
    while len(seeds) < params.masks:
        d += 1
        at = draw(8, params.seed, 5, d) % pixels
        if load[at].mean() < draw(4, params.seed, 6, d) / 65536.0 / params.scale or at in owned:
            continue
        like = {p: float(load[p] @ load[at]) * params.scale**2 for p in range(pixels)}
        reached, front = set(), [at]
        while front:
            y, x = divmod(front.pop(), params.width)
            for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
                if 0 <= x + dx < params.width and 0 <= y + dy < params.height:
                    other = (y + dy) * params.width + x + dx
                    if other not in reached and like[other] > params.threshold:
                        reached.add(other)
                        front.append(other)
        owned |= reached
        values = {p: min(max(like[p] / params.colors, 0), 1) for p in reached}
        if max(values.values(), default=0) >= 0.01:
            masks |= {(len(seeds), *divmod(p, params.width)): v for p, v in values.items()}
            seeds.append(at)
    return masks, seeds


def test_masks_and_traces_are_the_slow_ones(cells, stack):
    px, params = stack
    u = np.zeros((params.width * params.height, params.dim))
    for row in cells.svd.u.collect():
        u[row["row"], row["k"]] = row["val"]
    s = np.array([r["val"] for r in cells.svd.s.orderBy("k").collect()])
    vt = np.zeros((params.dim, fx.DAYS))
    for row in cells.svd.vt.collect():
        vt[row["k"], row["t"]] = row["val"]
    assert cells.masks.grown == params.masks
    masks, seeds = slow_masks(u[:, 1 : params.colors], params)
    assert [r["row"] for r in cells.masks.seed.orderBy("m").collect()] == seeds
    found = {(r["m"], r["y"], r["x"]): r["val"] for r in cells.masks.mask.collect()}
    assert found.keys() == masks.keys() and all(found[k] == pytest.approx(masks[k]) for k in masks)
    traces = {(r["m"], r["t"]): r["val"] for r in cells.signals.collect()}
    for m, seed in enumerate(seeds):
        part = (u[seed, 1 : params.colors] * s[1 : params.colors]) @ vt[1 : params.colors]
        assert [traces[m, t] for t in range(fx.DAYS)] == pytest.approx(part.tolist())
        assert [r["val"] for r in factor.seed_trace(cells.svd, seed, params.colors).orderBy("t").collect()] == pytest.approx(part.tolist())
    assert (u * s) @ vt == pytest.approx(rank_of(dense(px, params), params.dim), abs=1e-6)


def rank_of(matrix, k):
    u, s, v = np.linalg.svd(matrix, full_matrices=False)
    return (u[:, :k] * s[:k]) @ v[:k]


def test_pixel_colours_and_shapes_are_the_slow_ones(spark, cells, stack):
    _, params = stack
    weights = {}
    s = {r["k"]: r["val"] for r in cells.svd.s.collect()}
    for row in cells.svd.u.where(F.col("k").between(1, params.colors - 1)).collect():
        weights.setdefault(row["row"], {})[row["k"]] = row["val"] * s[row["k"]]
    part = lambda k, i: 2 * (draw(4, params.seed, i, k) + 0.5) / 65536 - 1
    strength = {row: sum(map(abs, own.values())) for row, own in weights.items()}
    scale = np.mean(list(strength.values())) + 3 * np.std(list(strength.values()), ddof=1)
    for row in cells.pixel_colours.collect():
        own = weights[row["row"]]
        x, y = (sum(v * part(k, i) for k, v in own.items()) for i in (0, 1))
        assert row["hue"] == pytest.approx(np.arctan2(y, x) / (2 * np.pi) + 0.5)
        assert row["saturation"] == pytest.approx(min(strength[row["row"]] / scale, 0.999))
    coloured = programs.colour_shapes(stack[0], fx.DAYS, params)[1]
    tone = {k: np.array([(draw(4, params.seed, i, k) + 0.5) / 65536 for i in range(3)]) for k in range(1, params.colors)}
    for row in coloured.collect():
        mixed = 0.33 + sum(v / (50 * params.colors) * tone[k] * 0.02 / (0.33 * tone[k].sum()) for k, v in weights[row["row"]].items())
        expected = np.floor(np.clip(mixed * mixed.std() * params.colors, 0, 1) * 255 + 1e-9)
        assert abs(np.array([row["r"], row["g"], row["b"]]) - expected).max() <= 1


def test_rows_outside_the_plane_are_refused(spark):
    u = spark.createDataFrame([(0, 1, 0.5), (6, 1, 0.5)], "row long, k int, val double")
    with pytest.raises(ValueError, match="outside"):
        grow.grow_masks(spark, u, SvdParams(2, 3, dim=2, colors=2, masks=1))


def test_cells_are_written_and_read_back(spark, cells, stack, tmp_path):
    px, params = stack
    folder = tmp_path / "cells"
    outputs.write_cells(cells, px, fx.DAYS, params, str(folder))
    assert json.loads((folder / "dims.json").read_text()) == {"width": params.width, "height": params.height, "time": fx.DAYS}
    boxes = {r["m"]: r for r in cells.masks.bbox.collect()}
    traces = {(r["m"], r["t"]): r["val"] for r in cells.traces.collect()}
    for m in range(params.masks):
        own = folder / "cell" / f"{m:04d}"
        assert json.loads((own / "bb.json").read_text()) == {k: boxes[m][k] for k in ("xmin", "xmax", "ymin", "ymax")}
        assert json.loads((own / "signal.json").read_text()) == pytest.approx([traces[m, t] for t in range(fx.DAYS)])
        for name in ("color", "gray"):
            assert decoded((own / f"{name}.png").read_bytes()).shape == (params.height, params.width, 3)
    for name, channels in (("recons_c", 3), ("raw", 1), ("raw_c", 3)):
        pictures = [decoded((folder / name / f"{t:04d}.png").read_bytes()) for t in range(fx.DAYS)]
        assert {p.shape for p in pictures} == {(params.height, params.width, channels)}
        if name == "raw":
            matrix = dense(px, params)
            grey = np.floor(matrix * 255 / matrix.max()).astype(np.uint8)
            assert np.array_equal(np.stack([p.reshape(-1) for p in pictures], axis=1), grey)
    frames = {(r["t"], r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in cells.frames.where("t = 3").collect()}
    picture = decoded((folder / "recons_c" / "0003.png").read_bytes())
    assert all(tuple(picture[y, x]) == rgb for (_, y, x), rgb in frames.items())
    assert not [p for p in folder.rglob("*") if p.is_file() and p.suffix not in (".json", ".png")]


def test_raw_outputs_are_read_back(spark, stack, tmp_path):
    px, params = stack
    values, coloured = programs.colour_shapes(px, fx.DAYS, params, cache=str(tmp_path / "factors"))
    outputs.write_reconstruction(values, str(tmp_path / "denoised.raw"), fx.DAYS, params)
    written = np.fromfile(tmp_path / "denoised.raw", "<u2").reshape(fx.DAYS, -1)
    expected = np.clip(rank_of(dense(px, params), params.dim), 0, 65535).T
    assert abs(written - expected).max() <= 1
    outputs.write_shapes(coloured, str(tmp_path / "stack.shapes"), params)
    rgb = np.fromfile(tmp_path / "stack.shapes", np.uint8).reshape(-1, 3)
    assert all(tuple(rgb[r["row"]]) == (r["r"], r["g"], r["b"]) for r in coloured.collect())
    cache = str(tmp_path / "factors")
    written = (tmp_path / "factors" / "label").stat().st_mtime_ns
    kept = programs.factors(px, fx.DAYS, params.dim, cache)  # read, not computed again
    assert (tmp_path / "factors" / "label").stat().st_mtime_ns == written
    for other, dim in ((px, 3), (px.where("px < 40"), params.dim), (px.withColumn("v", F.col("v") + 1), params.dim)):
        assert len(programs.factors(other, fx.DAYS, dim, str(tmp_path / f"{dim}")).s.collect()) == dim
        fresh = programs.factors(other, fx.DAYS, dim, cache)  # what is kept belongs to another stack or rank
        assert fresh.s.count() == dim and programs.kept_label(spark, cache)["dim"] == dim
    kept = programs.factors(px, fx.DAYS, params.dim, cache)
    outputs.write_component_stack(kept, str(tmp_path / "parts.raw"), params)
    parts = np.fromfile(tmp_path / "parts.raw", "<u2").reshape(params.dim, -1)
    assert all(parts[r["k"], r["row"]] == r["v"] for r in outputs.component_stack(kept).collect())
    assert len(kept.s.collect()) == kept.rank == params.dim


def test_straightened_volume_and_one_slice_are_written(spark, tmp_path):
    params = StraightenParams(out_width=4, out_extra=1)
    voxels, line = fx.voxels(spark, SF_DIR).cache(), np.array([c[1:] for c in fx.CONTROLS])
    whole = programs.straighten(spark, voxels, catalogue.SHAPE, params, controls=line)
    outputs.write_straightened(whole, str(tmp_path / "whole.raw"))
    shape = whole.shape
    cube = np.fromfile(tmp_path / "whole.raw", "<u2").reshape(shape.depth, shape.height, shape.width)
    assert all(cube[r["z"], r["y"], r["x"]] == r["v"] for r in whole.volume.collect()) and cube.any()
    one = programs.straighten(spark, voxels, catalogue.SHAPE, StraightenParams(out_width=4, out_extra=1, out_slice=3), controls=line)
    assert one.shape.depth == 1 and one.volume.select("z").distinct().count() == 1
    # slice 3 of a source of 7 planes lies on the line, as does the plane in the middle of the whole output
    assert {tuple(r[1:]) for r in one.volume.collect()} == {tuple(r[1:]) for r in whole.volume.where(F.col("z") == shape.depth // 2).collect()}


def test_controls_reach_a_file_and_come_back(spark, tmp_path):
    text_files.write_controls(fx.controls(spark), str(tmp_path / "line"))
    assert sorted(map(tuple, text_files.read_controls(spark, str(tmp_path / "line")).collect())) == fx.CONTROLS


def test_steps_on_arrays_are_those_of_tables(spark):
    samples = catalogue.bright(spark, SF_DIR)
    rows = samples.collect()
    places, line = np.array([[r["z"], r["y"], r["x"]] for r in rows], float), np.array([c[1:] for c in fx.CONTROLS])
    for params in (StraightenParams(), StraightenParams(spread=True), StraightenParams(weighted=True)):
        found = contour.contour_step(fx.controls(spark), samples, params).orderBy("idx").collect()
        weights = np.array([r["v"] if params.weighted else 1 for r in rows], float)
        moved = contour.array_step(line, places, weights, params)
        assert np.array([[r["z"], r["y"], r["x"]] for r in found]) == pytest.approx(moved)
        assert [r["move"] for r in found] == pytest.approx(np.sqrt(((moved - line) ** 2).sum(axis=1)).tolist())


def test_the_contour_loop_stops_as_its_rule_says():
    line = np.array([[0.0, 0, 0], [0, 10, 0], [0, 20, 0]])
    pool = np.array([[0.0, y, 0] for y in range(21)] * 9)
    params = StraightenParams(contour_points=21, stable_iterations=7, replaced_per_iteration=2)
    asked = []
    drawn = lambda: contour.Draws(lambda a, b: asked.append((a, b)) or (pool[a:b], np.ones(b - a)), 21)
    _, iterations, settled = contour.refine_line(line, drawn(), params)
    now, run, expected = line, 0, None  # moves are small from the start, so the first full run ends it
    for i in range(1, 20):
        moved = contour.array_step(now, pool[:21], np.ones(21), params)  # draws repeat the same places
        run = run + 1 if np.sqrt(((moved - now) ** 2).sum(axis=1)).mean() < params.move_threshold else 0
        now = moved
        if run == 7 and expected is None:
            expected = i
    assert settled and iterations == expected
    assert asked == [(21 * n, 21 * n + 21) for n in range(len(asked))]  # none is asked for twice
    few = StraightenParams(contour_points=21, move_threshold=0.0, max_iterations=9, replaced_per_iteration=2)
    assert contour.refine_line(line, drawn(), few)[1:] == (9, False)


def test_a_line_that_does_not_settle_is_tried_again(spark, monkeypatch):
    real, tries = contour.refine_line, []
    monkeypatch.setattr(contour, "refine_line", lambda *a: tries.append(1) or ((*real(*a)[:2], len(tries) > 2)))
    monkeypatch.setattr(graph, "backbone", lambda *a: fx.controls(spark))
    params = StraightenParams(mst_points=12, contour_points=50, stable_iterations=5, max_iterations=20)
    line, _ = programs.find_backbone(spark, fx.voxels(spark, SF_DIR), params)
    assert len(tries) == 3 and len(line) > 1
    monkeypatch.setattr(contour, "refine_line", lambda *a: (*real(*a)[:2], False))
    with pytest.raises(ValueError, match="settled"):
        programs.find_backbone(spark, fx.voxels(spark, SF_DIR), params, attempts=2)


def slow_tree(points):
    """Edges (u, w, d) of the spanning tree whose edges come first by (d, u, w), one added after another."""
    left, edges = set(range(1, len(points))), []
    while left:
        d, u, w = min((float(np.linalg.norm(points[i] - points[j])), min(i, j), max(i, j)) for i in left for j in range(len(points)) if j not in left)
        edges.append((u, w, d))
        left.discard(u if u in left else w)
    return sorted(edges)


def slow_reach(edges, root):
    near, reached, front = {}, {root: (-1, 0.0)}, [root]
    for u, w, d in edges:
        near.setdefault(u, []).append((w, d))
        near.setdefault(w, []).append((u, d))
    while front:
        at = front.pop()
        for other, d in near.get(at, []):
            if other not in reached:
                reached[other] = at, reached[at][1] + d
                front.append(other)
    return reached


@pytest.mark.parametrize("pairs", [20, graph.ALL_PAIRS])
def test_trees_by_pairs_and_by_grid_are_the_slow_one(spark, monkeypatch, pairs):
    monkeypatch.setattr(graph, "ALL_PAIRS", pairs)
    rng, n = np.random.default_rng(3), 40
    places = np.concatenate((rng.integers(0, 5, (n - 2, 3)), rng.uniform(-60, 60, (2, 3)))).astype(float)  # with ties
    places[5:9] = places[20]  # and repeated points
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], "idx int, z double, y double, x double")
    found = sorted(map(tuple, graph.minimum_spanning_tree(points.repartition(3)).select("u", "w", "d").collect()))
    assert len({tuple(p) for p in places}) < n
    slow = slow_tree(places)
    assert [e[:2] for e in found] == [e[:2] for e in slow] and [e[2] for e in found] == pytest.approx([e[2] for e in slow])


def test_paths_of_odd_trees_are_the_slow_ones(spark):
    rng = np.random.default_rng(4)
    star = [(0, i, float(i % 3)) for i in range(1, 60)]
    wild = [(int(rng.integers(0, i)) if i % 4 else i - 1, i, float(rng.integers(0, 4))) for i in range(1, 70)]
    for edges, root in ((star, 7), (wild, 0), ([(5, 9, 0.0)], 9)):
        tree = spark.createDataFrame(edges, "u int, w int, d double").repartition(3)
        slow = slow_reach(edges, root)
        assert {r["node"]: (r["prev"], pytest.approx(r["dist"])) for r in tours.tree_reach(tree, root).collect()} == slow
        farthest = lambda reached: min(reached, key=lambda n: (-round(reached[n][1], 9), n))
        first = farthest(slow)
        back = slow_reach(edges, first)
        second = farthest(back)
        path = [second]
        while back[path[-1]][0] >= 0:
            path.append(back[path[-1]][0])
        tip1, tip2, length, along = tours.diameter(tree, root)
        assert (tip1, tip2) == (first, second) and length == pytest.approx(back[second][1])
        assert [r["node"] for r in along.orderBy("idx").collect()] == path


def test_a_path_of_many_edges_is_whole(spark):
    n = 100_000
    mixed = (F.col("id") * 7919 % n).cast("int")  # neighbours on the path lie anywhere in the table
    edges = spark.range(n - 1).select(mixed.alias("u"), ((F.col("id") + 1) * 7919 % n).cast("int").alias("w"), F.lit(1.0).alias("d"))
    _, _, length, along = tours.diameter(edges, 5)
    assert length == n - 1 and along.count() == along.select("node").distinct().count() == n
    assert {r["node"] for r in along.where(F.col("idx").isin(0, n - 1)).collect()} == {0, (n - 1) * 7919 % n}


def test_roots_of_components(spark):
    least = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, 3), (9, 8), (8, 9), (12, 4)], "comp int, to int")
    assert {r["comp"]: r["root"] for r in graph.roots(least).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 12: 1, 8: 8, 9: 8}


def test_the_backbone_of_a_long_path_is_whole(spark):
    points = spark.range(40).select(F.col("id").cast("int").alias("idx"), F.lit(0.0).alias("z"), F.lit(0.0).alias("y"), (F.col("id") * 1.5).alias("x"))
    line = [r["x"] for r in graph.backbone(spark, points.repartition(3)).orderBy("idx").collect()]
    assert sorted(line) == [1.5 * i for i in range(40)] and line in (sorted(line), sorted(line)[::-1])
    assert [r["node"] for r in graph.backbone(spark, points.where("idx = 3")).collect()] == [3]


def test_many_controls_are_met_in_a_grid(spark, monkeypatch):
    rng = np.random.default_rng(8)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 90, (60, 3)))], "d int, z double, y double, x double")
    controls = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 9, (30, 3)))], "idx int, z double, y double, x double")
    few = {(r["d"], r["nn"]) for r in neighbours.nearest(points, controls).collect()}
    monkeypatch.setattr(neighbours, "BROADCAST_ROWS", 5)
    assert {(r["d"], r["nn"]) for r in neighbours.nearest(points, controls).collect()} == few


@pytest.mark.parametrize("block", [4, stats.BLOCK])
def test_the_strongest_partners_are_those_of_all_pairs(spark, block):
    rng = np.random.default_rng(9)
    values = {(m, t): float(rng.normal() + m) for m in range(17) for t in range(9) if rng.random() < 0.8}
    values |= {(20, t): 5.0 for t in range(9)} | {(21, 0): 1.0, (21, 1): 2.0}  # flat, and too short
    values |= {(22, t): values.get((3, t), 0.0) for t in range(9)} | {(23, t): values.get((3, t), 0.0) for t in range(9)}  # ties
    expected = []
    for a in sorted({m for m, _ in values}):
        found = []
        for b in {m for m, _ in values} - {a}:
            for lag in range(4):
                both = [(values[a, t], values[b, t + lag]) for t in range(9) if (a, t) in values and (b, t + lag) in values]
                x, y = np.array(both).T if both else ([], [])
                if len(both) >= 3 and np.std(x) > 1e-9 and np.std(y) > 1e-9:
                    found.append((-round(float(np.corrcoef(x, y)[0, 1]), 9), b, lag))
        expected += [(a, i + 1, b, lag, -r) for i, (r, b, lag) in enumerate(sorted(found)[:5])]
    table = spark.createDataFrame([(m, t, v) for (m, t), v in values.items()], "m int, t int, val double").repartition(3)
    rows = stats.delayed_correlation(table, 3, 5, least=3, block=block).orderBy("a", "rank").collect()
    assert [tuple(r)[:4] for r in rows] == [e[:4] for e in expected] and [r["r"] for r in rows] == pytest.approx([e[4] for e in expected])


def test_the_depth_of_an_output_and_its_slice():
    source = resample.Shape(7, 20, 16)
    assert resample.output_shape(source, 12.7, StraightenParams()) == resample.OutputShape(4, 20, 4, 4, None)
    assert resample.output_shape(source, 12.7, StraightenParams(out_slice=80)).depth == 1
    with pytest.raises(ValueError):
        resample.output_shape(resample.Shape(3, 20, 16), 12.7, StraightenParams())


def test_raw_sizes_give_the_depth(tmp_path):
    np.zeros(5 * 4 * 3, "<u2").tofile(tmp_path / "v.raw")
    assert raw_volume.RawVolumeReader({"path": str(tmp_path / "v.raw"), "width": "4", "height": "3"}).depth() == 5
