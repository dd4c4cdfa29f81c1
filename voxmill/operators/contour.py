"""Refinement of a centre line: weighted centroids, curvature stencil, and the loop around them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import AXES
from ..params import StraightenParams
from .neighbours import nearest


def neighbour_credit(assigned: DataFrame, n: int) -> DataFrame:
    """Every sample also counts for the controls before and after its own, where there are such."""
    spread = assigned.withColumn("nn", F.explode(F.array(F.col("nn") - 1, F.col("nn"), F.col("nn") + 1)))
    return spread.where((F.col("nn") >= 0) & (F.col("nn") < n))


def weighted_centroids(assigned: DataFrame, weight: Column | None = None) -> DataFrame:
    """(nn, n, w, cz, cy, cx) per control."""
    w = F.lit(1) if weight is None else weight
    sums = [(F.sum(F.col(a) * w) / F.sum(w)).alias(f"c{a}") for a in AXES]
    return assigned.groupBy("nn").agg(F.count("*").alias("n"), F.sum(w).cast("long").alias("w"), *sums)


def curvature_stencil(controls: DataFrame) -> DataFrame:
    """``controls`` with m2, m1, p1 and p2 of each axis: two neighbours each way, reflected beyond the ends.

    The window holds the controls of one line, a parameter-sized set.
    """
    order = Window.orderBy("idx")
    columns = []
    for a in AXES:
        here = F.col(a)
        before, after = F.lag(a, 1).over(order), F.lead(a, 1).over(order)
        before2, after2 = F.lag(a, 2).over(order), F.lead(a, 2).over(order)
        columns += [
            F.coalesce(before, 2 * here - after).alias(f"m1{a}"),
            F.coalesce(before2, 2 * before - here, 3 * here - 2 * after).alias(f"m2{a}"),
            F.coalesce(after, 2 * here - before).alias(f"p1{a}"),
            F.coalesce(after2, 2 * after - here, 3 * here - 2 * before).alias(f"p2{a}"),
        ]
    return controls.select("*", *columns)


def contour_step(controls: DataFrame, samples: DataFrame, params: StraightenParams, key: str = "d") -> DataFrame:
    """(idx, z, y, x, move): all controls after one step, from their old positions.

    A control is drawn to the centroid of its samples (alpha), to its neighbours (beta), to where
    their curvature points (gamma), and held where it is (delta).
    """
    assigned = nearest(samples, controls, key)
    if params.spread:
        assigned = neighbour_credit(assigned, controls.count())
    centroids = weighted_centroids(assigned, F.col("v") if params.weighted else None)
    joined = curvature_stencil(controls).join(centroids, F.col("idx") == F.col("nn"), "left")
    total = params.alpha + 2 * params.beta + 2 * params.gamma + params.delta
    moved = []
    for a in AXES:
        near, far = F.col(f"m1{a}") + F.col(f"p1{a}"), F.col(f"m2{a}") + F.col(f"p2{a}")
        pull = params.alpha * F.coalesce(F.col(f"c{a}"), F.col(a)) + params.beta * near
        moved.append(((pull + params.gamma * (1.5 * near - 0.5 * far) + params.delta * F.col(a)) / total).alias(f"n{a}"))
    stepped = joined.select("idx", *AXES, *moved)
    gaps = [F.pow(F.col(f"n{a}") - F.col(a), 2) for a in AXES]
    return stepped.select("idx", *(F.col(f"n{a}").alias(a) for a in AXES), F.sqrt(gaps[0] + gaps[1] + gaps[2]).alias("move"))


def stable_runs(moves: DataFrame, threshold: float) -> DataFrame:
    """(iteration, run): how many iterations in a row, up to this one, moved less than ``threshold``."""
    order = Window.orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    island = F.sum((F.col("move") >= threshold).cast("int")).over(order)
    marked = moves.withColumn("island", island)
    within = Window.partitionBy("island").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    return marked.select("iteration", F.sum((F.col("move") < threshold).cast("long")).over(within).alias("run"))


def array_step(line: np.ndarray, samples: np.ndarray, weights: np.ndarray, params: StraightenParams) -> np.ndarray:
    """One contour step on arrays; the same result as ``contour_step``."""
    n = len(line)
    away = ((samples[:, None, :] - line[None, :, :]) ** 2).sum(axis=2)
    own = away.argmin(axis=1)
    sums, total = np.zeros_like(line), np.zeros(n)
    for shift in (-1, 0, 1) if params.spread else (0,):
        to = own + shift
        inside = (to >= 0) & (to < n)
        np.add.at(sums, to[inside], samples[inside] * weights[inside, None])
        np.add.at(total, to[inside], weights[inside])
    centroid = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-300)[:, None], line)
    padded = np.concatenate(([3 * line[0] - 2 * line[1], 2 * line[0] - line[1]], line, [2 * line[-1] - line[-2], 3 * line[-1] - 2 * line[-2]]))
    near, far = padded[1 : n + 1] + padded[3 : n + 3], padded[:n] + padded[4 : n + 4]
    pulled = params.alpha * centroid + params.beta * near + params.gamma * (1.5 * near - 0.5 * far) + params.delta * line
    return pulled / (params.alpha + 2 * params.beta + 2 * params.gamma + params.delta)


class Draws:
    """Draws in order, fetched in blocks as they are asked for; none is given twice.

    ``fetch`` gives the places and weights of the draws from one number up to another.
    """

    def __init__(self, fetch: Callable[[int, int], tuple[np.ndarray, np.ndarray]], block: int):
        self.fetch, self.block, self.given, self.held = fetch, block, 0, (np.empty((0, 3)), np.empty(0))
        self.fetched = 0

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.held[1]) < n:
            more = self.fetch(self.fetched, self.fetched + self.block)
            self.fetched += self.block
            self.held = tuple(np.concatenate(parts) for parts in zip(self.held, more, strict=True))
        taken, self.held = tuple(h[:n] for h in self.held), tuple(h[n:] for h in self.held)
        self.given += n
        return taken


def refine_line(line: np.ndarray, draws: Draws, params: StraightenParams) -> tuple[np.ndarray, int, bool]:
    """(line, iterations, converged) of the contour loop.

    The first ``contour_points`` draws are the sample, and each iteration the next ones overwrite slots of
    it. Line and sample are as large as the parameters say, so a step runs on arrays: a thousand small
    jobs would only wait for the scheduler. Draws come from the volume, a block at a time.
    """
    if len(line) < 2:
        raise ValueError("a line needs at least two controls")
    places, weights = draws.take(params.contour_points)
    slots, run = np.random.default_rng(params.seed), 0
    for iteration in range(1, params.max_iterations + 1):
        moved = array_step(line, places, weights, params)
        move = np.sqrt(((moved - line) ** 2).sum(axis=1)).mean()
        line = moved
        run = run + 1 if move < params.move_threshold else 0
        if run >= params.stable_iterations:
            return line, iteration, True
        new_places, new_weights = draws.take(params.replaced_per_iteration)
        slot = slots.integers(len(places), size=params.replaced_per_iteration)
        for at, place, weight in zip(slot, new_places, new_weights, strict=True):  # a later draw may overwrite an earlier one
            places[at], weights[at] = place, weight
    return line, params.max_iterations, False
