"""Lag products, whose shuffle does not grow with the number of lags."""

import numpy as np
import pytest

from voxmill.operators import spectrum


@pytest.mark.parametrize("n, lags", [(1, 3), (5, 12), (40, 7), (41, 16), (43, 8)])
def test_lag_products_of_runs_are_those_of_the_whole_series(spark, monkeypatch, n, lags):
    monkeypatch.setattr(spectrum, "CHUNK", 8)
    values = np.random.default_rng(n).integers(1, 50000, n) / 100
    expected = {lag: float(values @ np.roll(values, -lag)) for lag in range(1, lags + 1)}
    series = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double").repartition(3)
    products = spectrum.lag_products(series, n, lags)
    assert {r["lag"]: r["r"] for r in products.collect()} == pytest.approx(expected, rel=1e-12)
    placed = spectrum.placed_in_runs(series, n, lags).count()
    assert placed <= n + -(-n // 8) * lags  # not one row for each lag
