"""Column functions for points, indices and hashed draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def distance(a: str, b: str) -> Column:
    """Euclidean distance of the points with column prefixes ``a`` and ``b``."""
    squares = [F.pow(F.col(f"{a}{axis}") - F.col(f"{b}{axis}"), 2) for axis in AXES]
    return F.sqrt(squares[0] + squares[1] + squares[2])


def hash16(*parts: Column | int | str) -> Column:
    """A reproducible draw from 0..65535 for a key; the same in every SQL engine that has MD5."""
    columns = [part if isinstance(part, Column) else F.lit(part) for part in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(c.cast("string") for c in columns)).cast("binary")), 1, 4), 16, 10).cast("int")


def hash32(*parts: Column | int | str) -> Column:
    """As ``hash16``, from 0..4294967295."""
    columns = [part if isinstance(part, Column) else F.lit(part) for part in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(c.cast("string") for c in columns)).cast("binary")), 1, 8), 16, 10).cast("long")


def hash60(*parts: Column | int | str) -> Column:
    """As ``hash16``, from 0..2^60 - 1."""
    columns = [part if isinstance(part, Column) else F.lit(part) for part in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(c.cast("string") for c in columns)).cast("binary")), 1, 15), 16, 10).cast("long")


def linear_index(width: int, height: int, z: str = "z", y: str = "y", x: str = "x") -> Column:
    return F.col(z).cast("long") * (width * height) + F.col(y) * width + F.col(x)


def voxel_value(value: Column) -> Column:
    """A number cut to 16 bit."""
    return F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(65535.0))).cast("int")


def hue_angle(y: Column, x: Column) -> Column:
    """Direction of a vector in turns, moved to 0..1; the zero vector has 0."""
    turn = F.atan2(y, x) / F.lit(6.283185307179586) + 0.5
    return F.when((x == 0) & (y == 0), 0.0).otherwise(F.nanvl(turn, F.lit(0.0)))


def rescale(value: Column, least: Column, scale: Column) -> Column:
    return (value - least) / (scale - least)
