"""Display arithmetic as column expressions: magnitudes, normalising, opacity, colour spaces."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class numbers and names of lidar points.
LIDAR_CLASSES = {
    0: "created", 1: "unclassified", 2: "ground", 3: "low vegetation", 4: "medium vegetation", 5: "high vegetation", 6: "building", 7: "low point (noise)", 8: "model key point", 9: "water",
}
#: Opacity below which a particle is not drawn.
LEAST_OPACITY = 0.02


def magnitude(*parts: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))


def normalized(value: Column, lo: float, hi: float) -> Column:
    return (value - F.lit(float(lo))) / F.lit(float(hi) - float(lo)) if hi > lo else F.lit(0.0)


def opacity(value: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear through control points (position, opacity) sorted by position."""
    out = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        line = F.lit(float(y0)) + (value - F.lit(float(x0))) * F.lit((y1 - y0) / (x1 - x0)) if x1 > x0 else F.lit(float(y1))
        out = F.when(value < F.lit(float(x1)), line).otherwise(out)
    return F.when(value <= F.lit(float(points[0][0])), F.lit(float(points[0][1]))).otherwise(out)


def visible(alpha: Column) -> Column:
    return alpha >= F.lit(LEAST_OPACITY)


def srgb_to_linear(x: Column) -> Column:
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(x: Column) -> Column:
    return F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def lidar_class(code: Column) -> Column:
    out = F.lit("reserved")
    for k, name in LIDAR_CLASSES.items():
        out = F.when(code == k, F.lit(name)).otherwise(out)
    return out


def clamped(value: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), value))
