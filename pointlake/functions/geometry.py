"""Boxes, planes, frusta and bricks: driver-side values and the predicates they compile to."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[float, float, float]


@dataclass(frozen=True)
class Box:
    """An axis-aligned box, closed on all faces unless ``half_open`` (then without its upper ones)."""

    lower: Vec = (math.inf, math.inf, math.inf)
    upper: Vec = (-math.inf, -math.inf, -math.inf)
    half_open: bool = False

    @property
    def empty(self) -> bool:
        return any(not lo <= hi for lo, hi in zip(self.lower, self.upper))

    @property
    def center(self) -> Vec:
        return tuple((lo + hi) / 2 for lo, hi in zip(self.lower, self.upper))

    @property
    def diagonal(self) -> Vec:
        return tuple(hi - lo for lo, hi in zip(self.lower, self.upper))

    def axes_by_extent(self) -> tuple[int, int, int]:
        """Axes from the longest to the shortest; of equal ones the lower first."""
        return tuple(sorted(range(3), key=lambda a: (-self.diagonal[a], a)))

    def extended(self, point: Vec) -> "Box":
        return Box(tuple(map(min, self.lower, point)), tuple(map(max, self.upper, point)), self.half_open)

    def union(self, other: "Box") -> "Box":
        return Box(tuple(map(min, self.lower, other.lower)), tuple(map(max, self.upper, other.upper)), self.half_open)

    def overlaps(self, other: "Box") -> bool:
        return all(a <= d and c <= b for a, b, c, d in zip(self.lower, self.upper, other.lower, other.upper))

    def contains_box(self, other: "Box") -> bool:
        return all(a <= c and d <= b for a, b, c, d in zip(self.lower, self.upper, other.lower, other.upper))

    def contains_point(self, p: Vec) -> bool:
        return all(lo <= v and (v < hi if self.half_open else v <= hi) for lo, v, hi in zip(self.lower, p, self.upper))

    def contains(self, x: Column, y: Column, z: Column) -> Column:
        """Rows inside. Columns are compared as they are, so that the scan can use the bounds; NaN is outside."""
        tests = []
        for c, lo, hi in zip((x, y, z), self.lower, self.upper):
            if not math.isinf(lo) or lo > 0:
                tests.append(c >= F.lit(lo))
            if not math.isinf(hi) or hi < 0:
                tests.append(c < F.lit(hi) if self.half_open else c <= F.lit(hi))
            elif not math.isinf(lo) or lo > 0:
                tests.append(~F.isnan(c))
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def overlap(self, *edges: Column) -> Column:
        """Rows whose own box (lx, ly, lz, ux, uy, uz) touches this one."""
        tests = [lo <= F.lit(b) for lo, b in zip(edges[:3], self.upper)] + [hi >= F.lit(a) for hi, a in zip(edges[3:], self.lower)]
        return reduce(lambda a, b: a & b, tests)


def distance_to_box(x: Column, y: Column, z: Column, box: Box) -> Column:
    gaps = [F.greatest(F.lit(lo) - c, F.lit(0.0), c - F.lit(hi)) for c, lo, hi in zip((x, y, z), box.lower, box.upper)]
    return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])


def axis_order(dx: Column, dy: Column, dz: Column) -> Column:
    """The axes of three extents, longest first, as a string such as ``120``; of equal ones the lower first."""
    first = F.when((dx >= dy) & (dx >= dz), 0).when(dy >= dz, 1).otherwise(2)
    last = F.when((dz <= dx) & (dz <= dy), 2).when(dy <= dx, 1).otherwise(0)
    return F.concat(first.cast("string"), (F.lit(3) - first - last).cast("string"), last.cast("string"))


@dataclass(frozen=True)
class Frustum:
    """Six planes (a, b, c, d) that point inwards, and the eight corners they bound."""

    planes: tuple[tuple[float, float, float, float], ...]
    corners: tuple[Vec, ...]

    @classmethod
    def of_matrix(cls, matrix: list[list[float]]) -> "Frustum":
        """From a row-major projection-view matrix with clip space [-w, w]."""
        m = np.asarray(matrix, dtype=float)
        planes = [m[3] + sign * m[axis] for axis in range(3) for sign in (1, -1)]
        inverse = np.linalg.inv(m)
        corners = []
        for c in ((x, y, z, 1.0) for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)):
            p = inverse @ c
            corners.append(tuple(float(v) for v in p[:3] / p[3]))
        return cls(tuple(tuple(float(v) for v in p) for p in planes), tuple(corners))

    def may_touch(self, lower: tuple[Column, ...], upper: tuple[Column, ...]) -> Column:
        """Boxes that no plane of the frustum and no face of their own separates from it (conservative)."""
        tests = []
        for a, b, c, d in self.planes:  # the corner of the box that lies farthest inside must be inside
            far = [F.lit(n) * (hi if n >= 0 else lo) for n, lo, hi in zip((a, b, c), lower, upper)]
            tests.append(far[0] + far[1] + far[2] + F.lit(d) >= 0)
        for axis in range(3):
            own = [p[axis] for p in self.corners]
            tests += [lower[axis] <= F.lit(max(own)), upper[axis] >= F.lit(min(own))]
        return reduce(lambda p, q: p & q, tests)


def smallest_divisor(n: int) -> int:
    return next((d for d in range(2, math.isqrt(n) + 1) if n % d == 0), n)


def grid(n: int, dims: int = 3) -> tuple[int, ...]:
    """``n`` as a product of ``dims`` factors: smallest prime factors first, dealt over the axes in turn."""
    out, axis = [1] * dims, 0
    while n > 1:
        d = smallest_divisor(n)
        out[axis % dims] *= d
        n //= d
        axis += 1
    return tuple(out)


def brick(x: Column, y: Column, z: Column, bounds: Box, shape: tuple[int, int, int]) -> Column:
    """The brick of a grid over ``bounds`` that a row lies in, x fastest; half open, so that each row has one."""
    places = []
    for c, lo, hi, n in zip((x, y, z), bounds.lower, bounds.upper, shape):
        at = F.floor(F.lit(float(n)) * (c - F.lit(lo)) / F.lit(hi - lo)) if hi > lo else F.lit(0)
        places.append(F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)))
    return (places[0] + F.lit(shape[0]) * (places[1] + F.lit(shape[1]) * places[2])).cast("int")
