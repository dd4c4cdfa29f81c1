"""Column functions between colour spaces; colours are dicts of columns, bytes are 0..255."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi
# The D50 white point, the matrix from XYZ to linear sRGB, and the colour mapping's scales.
WHITE = (0.9643, 1.0, 0.8251)
TO_RGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
LIGHT, CHROMA, CHROMA_OF_LIGHT, CHROMA_FLOOR = 0.7, 0.426, 0.301, 0.125


def lab_to_xyz(light: Column, a: Column, b: Column) -> list[Column]:
    """Unit-scaled Lab to XYZ: the inverse of the cube root with its linear part near black."""

    def inverse(t: Column) -> Column:
        return F.when(t > 6.0 / 29.0, t * t * t).otherwise((t - 4.0 / 29.0) * (3 * (6.0 / 29.0) * (6.0 / 29.0)))

    middle = (light + 0.16) / 1.16
    return [inverse(middle + a / 5.0) * WHITE[0], inverse(middle) * WHITE[1], inverse(middle - b / 2.0) * WHITE[2]]


def xyz_to_rgb(xyz: list[Column]) -> list[Column]:
    """XYZ to bytes: linear RGB, cut near 0 and 1, gamma 2.4, truncated."""

    def byte(row: tuple[float, float, float]) -> Column:
        linear = row[0] * xyz[0] + row[1] * xyz[1] + row[2] * xyz[2]
        curved = F.when(linear <= 0.0031308, linear * 12.92).otherwise(F.pow(F.greatest(linear, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)
        kept = F.when(linear < 0.001, 0.0).when(linear > 0.999, 1.0).otherwise(curved)
        return F.floor(kept * 255.0).cast("int")

    return [byte(row) for row in TO_RGB]


def csl_to_lab(hue: Column, saturation: Column, light: Column) -> list[Column]:
    angle = TAU / 6 - hue * TAU
    chroma = saturation * CHROMA
    return [light * LIGHT, F.sin(angle) * chroma, F.cos(angle) * chroma]


def cl_to_lab(hue: Column, light: Column) -> list[Column]:
    angle = TAU / 6 - hue * TAU
    chroma = light * CHROMA_OF_LIGHT + CHROMA_FLOOR
    return [light * LIGHT, F.sin(angle) * chroma, F.cos(angle) * chroma]


def csl_to_xyz(hue: Column, saturation: Column, light: Column) -> list[Column]:
    return lab_to_xyz(*csl_to_lab(hue, saturation, light))


def csl_to_rgb(hue: Column, saturation: Column, light: Column) -> list[Column]:
    return xyz_to_rgb(csl_to_xyz(hue, saturation, light))


def cl_to_rgb(hue: Column, light: Column) -> list[Column]:
    return xyz_to_rgb(lab_to_xyz(*cl_to_lab(hue, light)))


def hsv_to_rgb(hue: Column, saturation: Column, value: Column) -> list[Column]:
    """HSV (hue in turns) to bytes: each channel falls from the value along a trapezoid of the hue."""

    def byte(shift: int) -> Column:
        k = (hue * 6 + shift) % 6
        fall = F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))
        return F.floor((value - value * saturation * fall) * 255.0).cast("int")

    return [byte(5), byte(3), byte(1)]
