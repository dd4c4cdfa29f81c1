"""Decompositions of wide tables by random mixtures, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.operators import factor, wide


def cells_of(spark, matrix):
    rows, columns = np.nonzero(matrix)
    return spark.createDataFrame([(int(r), int(c), float(matrix[r, c])) for r, c in zip(rows, columns)], "px int, t int, v double").repartition(5)


def dense(table, shape, *names):
    out = np.zeros(shape)
    for row in table.collect():
        out[tuple(row[n] for n in names)] = row["val"]
    return out


@pytest.mark.parametrize("fan", [2, wide.FAN])
def test_wide_tables_have_the_components_that_numpy_finds(spark, monkeypatch, fan):
    monkeypatch.setattr(wide, "FAN", fan)
    rng = np.random.default_rng(1)
    left, right = rng.normal(size=(60, 8)), rng.normal(size=(8, 4500)) * (rng.random((8, 4500)) < 0.1)
    matrix = (left * 2.0 ** -np.arange(8)) @ right
    matrix[7] = 0  # a row without a cell
    svd = factor.truncated_svd(cells_of(spark, matrix), 4500, 4)
    u, s, vt = np.linalg.svd(matrix, full_matrices=False)
    assert [r["val"] for r in svd.s.orderBy("k").collect()] == pytest.approx(s[:4].tolist(), rel=1e-8) and svd.rank == 4
    own_u, own_vt = dense(svd.u, (60, 4), "row", "k"), dense(svd.vt, (4, 4500), "k", "t")
    sign = np.sign(vt[np.arange(4), np.abs(vt[:4]).argmax(axis=1)])
    assert own_vt == pytest.approx(vt[:4] * sign[:, None], abs=1e-6) and own_u == pytest.approx(u[:, :4] * sign, abs=1e-6)


def test_a_table_of_low_rank_has_no_more_components(spark):
    rng = np.random.default_rng(2)
    matrix = np.outer(rng.normal(size=30), rng.normal(size=4200)) + np.outer(rng.normal(size=30), rng.normal(size=4200))
    svd = factor.truncated_svd(cells_of(spark, matrix), 4200, 6)
    assert svd.rank == 2 and [r["val"] for r in svd.s.orderBy("k").collect()] == pytest.approx(np.linalg.svd(matrix)[1][:2].tolist(), rel=1e-9)
    nothing = factor.truncated_svd(cells_of(spark, matrix).where("v > 1e9"), 4200, 6)
    assert nothing.rank == 0 and nothing.u.isEmpty() and nothing.vt.isEmpty()


def test_mixtures_are_normal_and_repeatable():
    draws = wide.mixed(np.arange(20_000), 5, 42)
    assert abs(draws.mean()) < 0.02 and abs(draws.std() - 1) < 0.02 and np.abs(np.corrcoef(draws.T) - np.eye(5)).max() < 0.04
    assert np.array_equal(wide.mixed(np.array([7, 3]), 5, 42), draws[[7, 3]])
