"""Spanning trees of points that lie in dense clusters."""

import numpy as np
import pytest

from voxmill.operators import graph


def prim_weights(places):
    """Sorted lengths of a minimum spanning tree, row by row of the distances."""
    left = np.ones(len(places), bool)
    left[0], near, lengths = False, np.linalg.norm(places - places[0], axis=1), []
    while left.any():
        at = np.flatnonzero(left)[near[left].argmin()]
        lengths.append(near[at])
        left[at] = False
        near = np.minimum(near, np.linalg.norm(places - places[at], axis=1))
    return np.sort(lengths)


def table(spark, places):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], "idx int, z double, y double, x double")


def test_clusters_are_connected_as_by_all_pairs(spark):
    rng = np.random.default_rng(3)
    middles = rng.uniform(0, 60, (4, 3))
    clusters = [m + rng.normal(0, size, (200, 3)) for m, size in zip(middles, (0.3, 0.3, 1, 6), strict=True)]
    places = np.concatenate([*clusters, rng.uniform(0, 60, (40, 3))])
    found = graph.tree_by_distance(table(spark, places)).toPandas()
    assert len(found) == len(places) - 1 and (found["u"] < found["w"]).all()
    assert np.sort(found["d"]) == pytest.approx(prim_weights(places))


def test_equal_lengths_are_taken_in_order(spark):
    """A lattice: all edges are of one length, and the tree is that of the lowest (u, w)."""
    places = [(z, y, x) for z in range(3) for y in range(4) for x in range(4)]
    points = table(spark, places)
    far = sorted(map(tuple, graph.tree_by_distance(points).select("u", "w").collect()))
    assert far == sorted(map(tuple, graph.boruvka(graph.pairwise_distances(points)).select("u", "w").collect()))


def test_the_inside_of_a_connected_cluster_is_not_listed(spark):
    """One comp in every cell but a far one: no pair of it is met, and the two that face each other give one edge."""
    inside = [(i, 0, 0.001 * i, 0.0, 0.0) for i in range(500)]
    points = spark.createDataFrame([*inside, (500, 1, 50.2, 0.0, 0.0), (501, 2, 51.0, 0.0, 0.0)], "idx int, comp int, z double, y double, x double")
    assert [tuple(r) for r in graph.close_pairs(points, points, 1.0).collect()] == [(500, 501, pytest.approx(0.8))]


def test_first_reach_follows_the_densest_cell(spark):
    rng = np.random.default_rng(5)
    spread, dense = rng.uniform(0, 1000, (2000, 3)), rng.uniform(500, 500.5, (1500, 3))
    points = table(spark, np.concatenate([spread, dense]))
    reach = graph.first_reach(points)
    assert points.groupBy(*graph.cells_of(reach)).count().agg({"count": "max"}).first()[0] <= graph.CELL_POINTS
    assert graph.first_reach(table(spark, spread)) > reach
