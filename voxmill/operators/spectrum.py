"""Autocorrelation of a series, and the shape of an unlabelled volume from it."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a band that a task transforms, and the number of bands from which on they grow instead.
BAND, MAX_BANDS = 1 << 16, 1 << 12
#: Places of a run of the series whose products are summed in one task.
CHUNK = 1 << 16


def placed_in_runs(series: DataFrame, n: int, max_lag: int) -> DataFrame:
    """(run, at, v): ``series`` (i, v) with i from 0 to n - 1, cut into runs of CHUNK places, each with the ``max_lag`` places after it."""
    i, at, last = F.col("i"), F.col("at"), (n - 1) // CHUNK
    # Places beyond the end are those from the start again.
    turns = F.explode(F.sequence(F.lit(0), F.floor((n - 1 + max_lag - i) / n).cast("int")))
    placed = series.where("v is not null").where((i >= 0) & (i < n)).select(i.cast("long").alias("i"), F.col("v").cast("double").alias("v"))
    placed = placed.withColumn("turn", turns).select((i + F.col("turn").cast("long") * n).alias("at"), "v")
    runs = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((at - max_lag) / CHUNK)), F.least(F.floor(at / CHUNK), F.lit(last))))
    return placed.select(runs.alias("run"), "at", "v")


def lag_products(series: DataFrame, n: int, max_lag: int) -> DataFrame:
    """(lag, r): circular autocorrelation of ``series`` (i, v) with i from 0 to n - 1, for few lags.

    A value is shuffled once, and twice near the start of a run. A run gives one sum for each lag, and these
    are added without an error.
    """
    chunk = CHUNK

    def sums(key: tuple, rows: pa.Table) -> pa.Table:
        start = key[0].as_py() * chunk
        own = min(chunk, n - start)
        values = np.bincount(rows.column("at").to_numpy() - start, rows.column("v").to_numpy(), minlength=own + max_lag)
        products = [float(values[:own] @ values[lag : lag + own]) for lag in range(1, max_lag + 1)]
        return pa.table({"lag": pa.array(range(1, max_lag + 1), pa.int32()), "r": products})

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"lag": pa.array([key[0].as_py()], pa.int32()), "r": [math.fsum(rows.column("r").to_pylist())]})

    parts = placed_in_runs(series, n, max_lag).groupBy("run").applyInArrow(sums, "lag int, r double")
    return parts.groupBy("lag").applyInArrow(add, "lag int, r double")


@dataclass(frozen=True)
class Transform:
    """A transform of ``rows * columns`` values, dealt as bands of rows and of columns.

    Value j lies at row j // columns and column j % columns; frequency k at row k % rows of the turned
    table, which has a row for each k % rows and a column for each k // rows.
    """

    rows: int
    columns: int
    row_band: int
    column_band: int

    @property
    def size(self) -> int:
        return self.rows * self.columns

    def twiddle(self, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        """exp(-2 pi i row column / size); the product is reduced first, for it may be large."""
        return np.exp(-2j * np.pi / self.size * ((row[:, None].astype(np.int64) * column[None, :]) % self.size))


def transform_for(n: int) -> Transform:
    """A transform of a power of two that is long enough for all lags of ``n`` values without wrapping.

    Bands hold about BAND values, or more where there would be more than MAX_BANDS of them.
    """
    bits = max(2, (2 * n - 1).bit_length())
    rows, columns = 1 << bits // 2, 1 << bits - bits // 2
    band = max(BAND, (1 << bits) // MAX_BANDS)
    return Transform(rows, columns, min(rows, max(1, band // columns)), min(columns, max(1, band // rows)))


TILE = "band int, other int, re binary, im binary"


def tiles(values: np.ndarray, other: int, step: int) -> pa.Table:
    """A band of values cut into the bands of the other side: rows [band, other, re, im]."""
    cuts = range(0, len(values), step)
    parts = [np.ascontiguousarray(values[at : at + step]) for at in cuts]
    return pa.table({
        "band": pa.array([at // step for at in cuts], pa.int32()), "other": pa.array([other] * len(parts), pa.int32()),
        "re": [p.real.tobytes() for p in parts], "im": [p.imag.tobytes() for p in parts],
    })


def joined(rows: pa.Table, height: int) -> np.ndarray:
    """The band that tiles of ``height`` rows make when they are laid side by side."""
    order = np.argsort(rows.column("other").to_numpy())
    real, imaginary = (rows.column(c).to_pylist() for c in ("re", "im"))
    return np.concatenate([(np.frombuffer(real[i]) + 1j * np.frombuffer(imaginary[i])).reshape(height, -1) for i in order], axis=1)


def autocorrelation(series: DataFrame, n: int, max_lag: int, center: bool = False) -> DataFrame:
    """(lag, r) for all lags up to ``max_lag`` (less than n): the circular autocorrelation of the first n values of ``series`` (i, v).

    By the power spectrum, in four steps over bands of a table of values: transforms down its columns,
    a turning shuffle, transforms along its rows, their squared size and the way back in the same
    task, another turning shuffle, and transforms down the columns again. Values are padded with zeros to a
    power of two, and lags that wrap are added afterwards. A task holds a band; there are at most
    MAX_BANDS, so a band grows with the series only beyond BAND * MAX_BANDS values.
    """
    top = min(max_lag, n - 1)
    plan = transform_for(n)
    values = series.where((F.col("i") >= 0) & (F.col("i") < n)).select(F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))
    if center:
        values = values.withColumn("v", F.col("v") - F.lit((values.agg(F.sum("v")).first()[0] or 0.0) / n))

    def down(key: tuple, rows: pa.Table) -> pa.Table:
        band = key[0].as_py()
        own = np.zeros((plan.rows, plan.column_band))
        i = rows.column("i").to_numpy()
        own[i // plan.columns, i % plan.columns - band * plan.column_band] = rows.column("v").to_numpy()
        columns = band * plan.column_band + np.arange(plan.column_band)
        return tiles(np.fft.fft(own, axis=0) * plan.twiddle(np.arange(plan.rows), columns), band, plan.row_band)

    def along(key: tuple, rows: pa.Table) -> pa.Table:
        band = key[0].as_py()
        power = np.abs(np.fft.fft(joined(rows, plan.row_band), axis=1)) ** 2
        back = np.fft.ifft(power, axis=1) * plan.twiddle(band * plan.row_band + np.arange(plan.row_band), np.arange(plan.columns)).conj()
        return tiles(np.ascontiguousarray(back.T), band, plan.column_band)

    def back_down(key: tuple, rows: pa.Table) -> pa.Table:
        band = key[0].as_py()
        r = np.fft.ifft(joined(rows, plan.column_band).T, axis=0).real
        place = np.arange(plan.rows)[:, None] * plan.columns + band * plan.column_band + np.arange(plan.column_band)[None, :]
        wanted = (place > 0) & (place < n) & ((place <= top) | (place >= n - top))
        return pa.table({"at": place[wanted], "r": r[wanted]})

    # A padded column without a value has only zeros, and is laid out all the same.
    bands = series.sparkSession.range(plan.columns // plan.column_band).select(F.col("id").cast("int").alias("band"))
    dealt = values.select((F.col("i") % plan.columns / plan.column_band).cast("int").alias("band"), "i", "v")
    first = dealt.groupBy("band").cogroup(bands.groupBy("band")).applyInArrow(lambda key, own, _: down(key, own), TILE)
    turned = first.groupBy("band").applyInArrow(along, TILE)
    found = turned.groupBy("band").applyInArrow(back_down, "at long, r double")
    lags = F.filter(F.array(F.col("at"), F.lit(n) - F.col("at")), lambda lag: lag <= top)
    wrapped = found.select(F.explode(lags).alias("lag"), "r")
    return wrapped.groupBy(F.col("lag").cast("int").alias("lag")).agg(F.sum("r").alias("r"))


def top_lags(correlation: DataFrame, n: int = 50, min_lag: int = 1) -> DataFrame:
    return correlation.where(F.col("lag") >= min_lag).orderBy(F.desc("r"), "lag").limit(n)


def shape_candidates(correlation: DataFrame, length: int, n: int, max_lag: int, max_width: int | None = None) -> DataFrame:
    """(width, height, depth, score): W is the lag (up to ``max_width``) with the highest correlation (to four digits, then the lowest lag); H any
    number for which W * H divides ``length``; the score is the correlation at lag W * H, null where that
    is not below n.
    """
    widths = correlation if max_width is None else correlation.where(F.col("lag") <= max_width)
    best = widths.agg(F.max_by("lag", F.struct(F.round("r", 4), -F.col("lag"))).alias("width"))
    heights = best.select("width", F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("height"))
    plane = F.col("width") * F.col("height")
    fits = heights.where((plane <= length) & (F.lit(length) % plane == 0))
    scores = correlation.select(F.col("lag").alias("at"), F.col("r").alias("score"))
    joined = fits.join(scores, (plane == F.col("at")) & (plane < n), "left")
    return joined.select(F.col("width").cast("int"), F.col("height").cast("int"), F.expr(f"cast({length} div (width * height) as int)").alias("depth"), "score")
