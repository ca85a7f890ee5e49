"""Synthetic particles. Each generator is a function of its seed alone, however Spark splits the range.

Random numbers are hashes of (seed, row, draw), so a recomputed partition gives the same rows.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.functions.geometry import Box


#: Ends of the runs in which ``spheres`` draws; a row goes on to the next run if it is not inside by then.
TRIES = (32, 1 << 8, 1 << 12, 1 << 16, 1 << 20)


def uniform01(seed: int, draw: int | Column, row: Column | None = None) -> Column:
    """A number in (0, 1) by hash."""
    h = F.xxhash64(F.lit(seed).cast("long"), F.lit(draw) if isinstance(draw, int) else draw, F.col("pid") if row is None else row)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * 2.0**-53


def normal(seed: int, draw: int | Column) -> Column:
    """Standard normal, Box-Muller from two draws."""
    return F.sqrt(-2 * F.log(uniform01(seed, draw))) * F.cos(2 * math.pi * uniform01(seed, draw + 1))


def _placed(ids: DataFrame, box: Box, fractions: tuple[Column, Column, Column]) -> DataFrame:
    axes = [(F.lit(lo) + f * (hi - lo)).cast("float").alias(n) for n, lo, hi, f in zip("xyz", box.lower, box.upper, fractions)]
    return ids.select("pid", *axes)


def uniform(spark: SparkSession, n: int, box: Box, seed: int = 0) -> DataFrame:
    return _placed(spark.range(n).withColumnRenamed("id", "pid"), box, tuple(uniform01(seed, i) for i in range(3)))


def linear_gradient(spark: SparkSession, n: int, box: Box, seed: int = 0, slabs: int = 100) -> DataFrame:
    """Slabs along x, each as dense as its number; a slab's rows are a whole number, so some are left over."""
    counts = [2 * n * (i + 1) // (slabs * (slabs + 1)) for i in range(slabs)]
    ends = [sum(counts[: i + 1]) for i in range(slabs)]
    slab = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("pid")))
    x = (slab + uniform01(seed, 0)) / slabs
    return _placed(spark.range(ends[-1]).withColumnRenamed("id", "pid"), box, (x, uniform01(seed, 1), uniform01(seed, 2)))


def exponential_gradient(spark: SparkSession, n: int, box: Box, seed: int = 0) -> DataFrame:
    x = F.least(F.lit(5.0), -F.log(uniform01(seed, 0))) / 5
    return _placed(spark.range(n).withColumnRenamed("id", "pid"), box, (x, uniform01(seed, 1), uniform01(seed, 2)))


def spheres(spark: SparkSession, n: int, count: int, box: Box, seed: int = 0) -> DataFrame:
    """Around ``count`` centres in the box; what falls outside is drawn again until it is inside.

    There are 32 tries, then longer runs for the rows that are still outside, up to the
    last of TRIES; only a row outside after all those is moved, along its last ray, to
    a random place inside. On an axis where the box has no extent all rows lie in the box.
    """
    pick = random.Random(seed)
    length = math.sqrt(sum(d * d for d in box.diagonal))
    centres = [(tuple(lo + pick.random() * d for lo, d in zip(box.lower, box.diagonal)), pick.uniform(0.05, 0.6) * length) for _ in range(count)]
    table = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("xyzr", (*c, r))]) for c, r in centres])
    ids = spark.range(n).withColumnRenamed("id", "pid").withColumn("c", F.get(table, F.floor(uniform01(seed, 0) * count).cast("int")))

    def ray(attempt: Column) -> tuple[list[Column], Column]:
        """Direction and share of the radius."""
        draw = F.lit(1) + F.lit(8) * attempt
        g = [normal(seed, draw + F.lit(2 * i)) for i in range(3)]
        return g, uniform01(seed, draw + F.lit(6))

    def at(attempt: Column) -> Column:
        g, u = ray(attempt)
        r = F.col("c.r") * u / F.sqrt(g[0] * g[0] + g[1] * g[1] + g[2] * g[2])
        return F.struct(*[(F.col(f"c.{k}") + r * v if d else F.col(f"c.{k}")).alias(k) for k, v, d in zip("xyz", g, box.diagonal)])

    def inside(p: Column) -> Column:
        return (p["x"] >= box.lower[0]) & (p["x"] <= box.upper[0]) & (p["y"] >= box.lower[1]) & (p["y"] <= box.upper[1]) & (p["z"] >= box.lower[2]) & (p["z"] <= box.upper[2])

    def run(first: int, last: int) -> Column:
        """The first try in [first, last) that is inside, or null; nothing is drawn after it."""
        none = F.lit(None).cast("struct<x:double,y:double,z:double>")
        return F.aggregate(F.sequence(F.lit(first), F.lit(last - 1)), none, lambda p, i: F.when(p.isNotNull(), p).otherwise(F.get(F.filter(F.array(at(i)), inside), F.lit(0))))

    def moved() -> Column:
        g, u = ray(F.lit(TRIES[-1]))
        walls = [((F.when(v > 0, F.lit(hi)).otherwise(F.lit(lo)) - F.col(f"c.{k}")) / v) for k, v, lo, hi in zip("xyz", g, box.lower, box.upper) if hi > lo]
        far = F.array_min(F.array(F.col("c.r") / F.sqrt(g[0] * g[0] + g[1] * g[1] + g[2] * g[2]), *walls))
        return F.struct(*[(F.col(f"c.{k}") + u * far * v if d else F.col(f"c.{k}")).alias(k) for k, v, d in zip("xyz", g, box.diagonal)])

    p = ids.withColumn("p", F.coalesce(*[run(a, b) for a, b in zip((0, *TRIES), TRIES)], moved()))
    return p.select("pid", *[F.col(f"p.{k}").cast("float").alias(k) for k in "xyz"])


def cut_box(spark: SparkSession, n: int, box: Box, cut: tuple[float, float, float], seed: int = 0) -> DataFrame:
    """Uniform in the box less a corner of the size ``cut``: slabs beside it, each by its volume, then in it."""
    (w, h, d), size = [min(c, e) for c, e in zip(cut, box.diagonal)], box.diagonal
    # three parts that make up the rest: beyond the cut in x; within it in x but beyond in y; within both but beyond in z
    volumes = [(size[0] - w) * size[1] * size[2], w * (size[1] - h) * size[2], w * h * (size[2] - d)]
    total = sum(volumes) or 1.0
    u, f = uniform01(seed, 3), [uniform01(seed, i) for i in range(3)]
    beyond = lambda i, c: (c + f[i] * (size[i] - c)) / size[i] if size[i] else F.lit(0.0)
    within = lambda i, c: f[i] * c / size[i] if size[i] else F.lit(0.0)
    first, second = u < volumes[0] / total, u < (volumes[0] + volumes[1]) / total
    x = F.when(first, beyond(0, w)).otherwise(within(0, w))
    y = F.when(first, f[1]).when(second, beyond(1, h)).otherwise(within(1, h))
    z = F.when(second, f[2]).otherwise(beyond(2, d))
    return _placed(spark.range(n).withColumnRenamed("id", "pid"), box, (x, y, z))


def attribute_range(seed: int) -> tuple[float, float]:
    pick = random.Random(seed)
    lo = pick.uniform(-10_000, 10_000)
    return lo, lo + pick.uniform(0.5, 5_000)


def with_attributes(df: DataFrame, kind: str, count: int, seed: int = 0, spatial: Box | None = None, double: bool = False) -> DataFrame:
    """Columns ``non-spatial-<kind><i>`` (uniform, normal) or, with a box, ``spatial-<kind><i>`` (gradient, sphere)."""
    for i in range(count):
        lo, hi = attribute_range(seed + i)
        draw = 100 + 4 * i
        if spatial is None:
            t = uniform01(seed, draw) if kind == "uniform" else F.least(F.lit(1.0), F.greatest(F.lit(0.0), normal(seed, draw) / 6 + 0.5))
            name = f"non-spatial-{kind}{i}"
        else:
            axis, size = i % 3, spatial.diagonal
            if kind == "gradient":
                t = (F.col("xyz"[axis]) - spatial.lower[axis]) / (size[axis] or 1.0)
            else:
                parts = [(F.col(c) - m) for c, m in zip("xyz", spatial.center)]
                radius = math.sqrt(sum(d * d for d in size)) / 2 or 1.0
                t = F.greatest(F.lit(0.0), 1 - F.sqrt(parts[0] ** 2 + parts[1] ** 2 + parts[2] ** 2) / radius)
            name = f"spatial-{kind}{i}"
        df = df.withColumn(name, (F.lit(lo) + t * (hi - lo)).cast("double" if double else "float"))
    return df


def advected(df: DataFrame, step: tuple[float, float, float], box: Box) -> DataFrame:
    """Every particle moved by ``step``; those that leave the box are gone."""
    moved = df.select(*[(F.col(c) + F.lit(s)).cast("float").alias(c) if (s := dict(zip("xyz", step)).get(c)) is not None else F.col(f"`{c}`") for c in df.columns])
    return moved.where(box.contains(F.col("x"), F.col("y"), F.col("z")))
