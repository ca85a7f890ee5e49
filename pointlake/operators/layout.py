"""Building the layout: bounds, subfiles, cells and levels of detail.

One aggregate for bounds, one for the histogram of blocks, a plan on the driver, then a
single shuffle of the rows to (subfile, cell), where k-d treelets are built. A treelet
holds the rows of one cell of one subfile, so its size is bounded by the subfile's.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointlake.functions import bitmap, lod, morton
from pointlake.functions.geometry import Box
from pointlake.plans import partition
from pointlake.schema import ParticleSchema

#: Rows below which a node is a leaf, and blocks an axis at most (as bits).
LEAF_ROWS, MOST_BLOCK_BITS = 128, 6
#: Rows of a map that is broadcast, at most (some 50 bytes each); beyond it Spark chooses the join.
MOST_BROADCAST = 1 << 20


def bounds_and_rows(df: DataFrame, schema: ParticleSchema) -> tuple[Box, int]:
    """The box of all positions that are numbers (empty without any), and the number of rows."""
    box, n, _ = described(df, schema, ())
    return box, n


def described(df: DataFrame, schema: ParticleSchema, attrs: tuple[str, ...]) -> tuple[Box, int, dict[str, tuple]]:
    """Bounds, rows and the ranges of ``attrs``, in one pass."""
    parts = [f(F.when(~F.isnan(c), F.col(c))).alias(f"{n}{i}") for i, c in enumerate(schema.positions) for n, f in (("l", F.min), ("u", F.max))]
    parts += [f(a).alias(f"{n}_{i}") for i, a in enumerate(attrs) for n, f in (("lo", F.min), ("hi", F.max))]
    r = df.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    ranges = {a: (r[f"lo_{i}"], r[f"hi_{i}"]) for i, a in enumerate(attrs)}
    if r.l0 is None or r.l1 is None or r.l2 is None:
        return Box(), r.n, ranges
    return Box((float(r.l0), float(r.l1), float(r.l2)), (float(r.u0), float(r.u1), float(r.u2))), r.n, ranges


def bounds_of(df: DataFrame, schema: ParticleSchema) -> Box:
    return bounds_and_rows(df, schema)[0]


def attribute_ranges(df: DataFrame, attrs: tuple[str, ...]) -> dict[str, tuple]:
    """Smallest and largest value by attribute over all rows."""
    if not attrs:
        return {}
    r = df.agg(*[f(a).alias(f"{n}_{i}") for i, a in enumerate(attrs) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {a: (r[f"lo_{i}"], r[f"hi_{i}"]) for i, a in enumerate(attrs)}


@dataclass(frozen=True)
class Options:
    bytes_per_subfile: int = 256 << 20
    find_best_axis: bool = False
    imbalance: float = 4.0
    overfull: float = 1.5
    fixed_subfiles: int = 0
    build_layout: bool = True
    #: A column that names blocks; by default cells of a grid over the bounds.
    block_column: str | None = None


def block_bits(rows: int, most: int) -> int:
    """Bits an axis such that a block of evenly spread rows is an eighth of a subfile or less."""
    return min(MOST_BLOCK_BITS, max(2, math.ceil(math.log2(max(1, 8 * rows / most)) / 3)))


#: Bits an axis by which a block above a subfile's size is cut, on its own bounds.
FINER_BITS = 3


def _finer(heavy: list, most: int, base: int) -> tuple[list[tuple], int]:
    """How each heavy block is cut: (block, first new id, lower corner and cells per length by axis, parts by hash); and the next free id.

    A block without extent is dealt into parts by a hash of its rows' ids.
    """
    cuts = []
    for r in heavy:
        spans = [0.0 if lo is None else hi - lo for lo, hi in ((r.l0, r.u0), (r.l1, r.u1), (r.l2, r.u2))]
        scales = [(1 << FINER_BITS) / s if s > 1e-300 else 0.0 for s in spans]
        parts = 0 if any(scales) else -(-r.n // most)
        cuts.append((r.b, base, *[0.0 if lo is None else lo for lo in (r.l0, r.l1, r.l2)], *scales, parts))
        base += max(parts, 1 << 3 * FINER_BITS)
    return cuts, base


def planned(df: DataFrame, schema: ParticleSchema, options: Options, bounds: Box | None = None, rows: int | None = None) -> tuple[DataFrame, partition.Plan, DataFrame]:
    """``df`` with ``subfile``, the plan, and the subfiles' boxes (one row each, from the histogram).

    Blocks above a subfile's capacity are cut into finer ones on their own bounds,
    again and again until each fits (only their rows are counted again), so that a
    hot spot becomes many blocks however small it is beside the whole; rows in one
    place are dealt by hash. Only rows that share position and id stay together.
    """
    most = partition.capacity(options.bytes_per_subfile, schema.bytes_per_row())
    corners = [f(F.when(~F.isnan(c), F.col(c))).cast("double").alias(f"{n}{i}") for i, c in enumerate(schema.positions) for n, f in (("l", F.min), ("u", F.max))]

    def counted(rows: DataFrame) -> dict:
        return {r.b: r for r in rows.groupBy(F.col("__block").alias("b")).agg(F.count(F.lit(1)).alias("n"), *corners).collect()}

    spark, base = df.sparkSession, 1 << 3 * morton.BITS
    if options.block_column:
        placed = df.withColumn("__block", F.col(options.block_column).cast("long"))
        found = counted(placed)
    else:
        if bounds is None or rows is None:
            bounds, rows = bounds_and_rows(df, schema)
        code = morton.morton3(*map(F.col, schema.positions), bounds) if not bounds.empty else F.lit(0).cast("long")
        placed = df.withColumn("__block", F.coalesce(morton.cell(code, block_bits(rows, most)), F.lit(0).cast("long")))
        found, done = counted(placed), set()
        # as many rows as there are blocks above a subfile's size: fewer than subfiles
        while heavy := [r for b, r in sorted(found.items()) if r.n > most and b not in done]:
            cuts, after = _finer(heavy, most, base)
            table = spark.createDataFrame(cuts, "__of long, __first long, __l0 double, __l1 double, __l2 double, __s0 double, __s1 double, __s2 double, __parts long")
            last = F.lit((1 << FINER_BITS) - 1)

            def cell(i: int, c: str) -> Column:
                at = F.least(last, F.greatest(F.lit(0), F.floor((F.col(c) - F.col(f"__l{i}")) * F.col(f"__s{i}")).cast("int")))
                return F.when(F.col(c).isNull() | F.isnan(c), 0).otherwise(at)

            x, y, z = (cell(i, c) for i, c in enumerate(schema.positions))
            inside = F.when(F.col("__parts") > 0, F.pmod(F.xxhash64(schema.pid), F.col("__parts"))).otherwise((x + (y + z * (1 << FINER_BITS)) * (1 << FINER_BITS)).cast("long"))
            joined = placed.join(F.broadcast(table), F.col("__block") == F.col("__of"), "left")
            placed = joined.withColumn("__block", F.when(F.col("__of").isNull(), F.col("__block")).otherwise(F.col("__first") + inside)).drop(*[f.name for f in table.schema])
            new = counted(placed.where(F.col("__block") >= base))
            done |= {b for c in cuts for b in range(c[1], c[1] + c[-1]) if b in new}
            gone = {r.b for r in heavy}
            found, base = {b: r for b, r in found.items() if b not in gone} | new, after
    blocks = [partition.Block(b, tuple(0.0 if v is None else v for v in (r.l0, r.l1, r.l2)), r.n) for b, r in sorted(found.items(), key=lambda x: (x[0] is None, x[0]))]
    if options.fixed_subfiles:
        plan = partition.fixed(blocks, options.fixed_subfiles)
    else:
        plan = partition.adaptive(blocks, most, options.find_best_axis, options.imbalance, options.overfull)
    edges = []
    for n, leaf in enumerate(plan.leaves):
        ends = [(f"{side}{i}", pick) for i in range(3) for side, pick in (("l", min), ("u", max))]
        values = {name: [v for b in leaf if (v := found[b.id][name]) is not None] for name, _ in ends}
        edges.append((n, *[pick(values[name]) if values[name] else None for name, pick in ends]))
    boxes = spark.createDataFrame(edges or [(0, *[None] * 6)], "subfile int, __l0 double, __u0 double, __l1 double, __u1 double, __l2 double, __u2 double")
    if len(plan.leaves) <= 1:
        return df.withColumn("subfile", F.lit(0)), plan, boxes
    # the map has a row a block: at most 2 ** (3 * MOST_BLOCK_BITS) and 512 for each one cut, fewer than subfiles
    table = spark.createDataFrame(list(plan.subfile_of().items()), "__of long, subfile int")
    table = F.broadcast(table) if len(found) <= MOST_BROADCAST else table
    return placed.join(table, F.col("__block").eqNullSafe(F.col("__of"))).drop("__block", "__of"), plan, boxes


def treelet(points: np.ndarray, pids: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """Level, node, place in the node and rows of the node for each point, and the split planes.

    Nodes are split at the median of the longest axis that has one; an inner node
    keeps NODE_ROWS rows, one from each of as many even stretches of its rows in
    order of ``pids``, picked by a hash of (seed, node, stretch). The result is a
    function of the rows alone, whatever order they come in.
    """
    n = len(points)
    level, node, idx, cnt = (np.zeros(n, np.int64) for _ in range(4))
    planes: list[tuple] = []
    deepest = 8 + 1.3 * math.log2(max(1, n))
    todo, made = [(np.argsort(pids, kind="stable"), 0)], 0

    def own(rows: np.ndarray, depth: int, name: int) -> None:
        level[rows], node[rows], idx[rows], cnt[rows] = depth, name, np.arange(len(rows)), len(rows)

    while todo:
        rows, depth = todo.pop()
        name, made = made, made + 1
        if len(rows) <= LEAF_ROWS + lod.NODE_ROWS or depth >= deepest:
            own(rows, depth, name)
            continue
        p = points[rows]
        lower, upper = np.nanmin(p, axis=0), np.nanmax(p, axis=0)
        step = len(rows) // lod.NODE_ROWS
        draws = np.random.Generator(np.random.Philox(key=[seed & 0xFFFFFFFFFFFFFFFF, name])).integers(0, step, lod.NODE_ROWS)
        picked = np.arange(lod.NODE_ROWS) * step + draws
        rest = np.delete(rows, picked)
        for axis in sorted(range(3), key=lambda a: (lower[a] - upper[a], a)):
            values = points[rest, axis]
            position = np.sort(values)[min(len(rest) - 1, len(rows) // 2)]
            left = values < position
            if position not in (lower[axis], upper[axis]) and left.any() and not left.all():
                own(rows[picked], depth, name)
                planes.append((name, depth, axis, float(position), *map(float, lower), *map(float, upper)))
                todo += [(rest[~left], depth + 1), (rest[left], depth + 1)]
                break
        else:
            own(rows, depth, name)
    return level, node, idx, cnt, planes


ADDED = [T.StructField("lod_level", T.IntegerType()), T.StructField("lod_node", T.IntegerType()), T.StructField("lod_idx", T.LongType()), T.StructField("lod_cnt", T.LongType())]


def with_cells(df: DataFrame, schema: ParticleSchema, boxes: DataFrame | None = None) -> DataFrame:
    """``df`` (with ``subfile``) with ``morton`` and ``cell`` on each subfile's own grid.

    Boxes and the counts that fix a subfile's grid have one row a subfile, no
    more than the plan that the driver made; they are broadcast, and the rows
    stay where they are.
    """
    x, y, z = schema.positions
    edge = boxes if boxes is not None else df.groupBy("subfile").agg(*[f(F.when(~F.isnan(c), F.col(c))).cast("double").alias(f"__{n}{i}") for i, c in enumerate(schema.positions) for n, f in (("l", F.min), ("u", F.max))])
    placed = df.join(F.broadcast(edge), "subfile")

    def grid(i: int, c: str) -> Column:
        span = F.col(f"__u{i}") - F.col(f"__l{i}")
        at = F.floor(F.lit(float((1 << morton.BITS) - 1)) * (F.col(c) - F.col(f"__l{i}")) / span).cast("long")
        return F.when((span > 0) & ~F.isnan(c), at).otherwise(F.lit(0).cast("long"))

    placed = placed.withColumn("morton", morton.interleaved(*[grid(i, c) for i, c in enumerate((x, y, z))])).drop(*[f"__{n}{i}" for i in range(3) for n in "lu"])
    cells = placed.groupBy("subfile", morton.cell(F.col("morton"), morton.COARSE_BITS).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    per = [F.count_distinct(F.shiftright("c", 3 * (morton.COARSE_BITS - b))).alias(f"d{b}") for b in range(1, morton.COARSE_BITS + 1)]
    known = cells.groupBy("subfile").agg(F.sum("n").alias("n"), *per)
    need = lambda b: F.col("n") / F.col(f"d{b}") > morton.CELL_ROWS
    bits = F.when((F.col("n") <= morton.CELL_ROWS) | (F.col("n") / F.col(f"d{morton.COARSE_BITS}") >= morton.CELL_ROWS), morton.COARSE_BITS)
    for b in range(morton.COARSE_BITS - 1, 1, -1):
        bits = bits.when(need(b), b)
    known = known.select("subfile", bits.otherwise(1).alias("cell_bits"))
    out = placed.join(F.broadcast(known), "subfile")
    return out.withColumn("cell", F.expr(f"shiftright(morton, 3 * ({morton.BITS} - cell_bits))").cast("int")).drop("cell_bits")


def built(df: DataFrame, schema: ParticleSchema) -> DataFrame:
    """``df`` (with subfile, cell) with the level columns of k-d treelets; other columns pass through as they are."""
    kind = T.StructType([*df.schema.fields, *ADDED])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        points = np.stack([rows.column(c).to_numpy().astype(np.float64) for c in schema.positions], axis=1)
        level, node, idx, cnt, _ = treelet(points, rows.column(schema.pid).to_numpy(), int(key[-1].as_py()))
        for field, values in zip(ADDED, (level.astype(np.int32), node.astype(np.int32), idx, cnt)):
            rows = rows.append_column(field.name, pa.array(values))
        return rows

    keys = [c for c in (schema.timestep, "subfile", "cell") if c]
    return df.groupBy(*keys).applyInArrow(run, kind)


PLANES = "subfile int, cell int, node int, level int, axis int, position double, lx double, ly double, lz double, ux double, uy double, uz double"


def split_planes(df: DataFrame, schema: ParticleSchema, keys: Sequence[str] = ("subfile", "cell")) -> DataFrame:
    """The planes at which treelets were split: one row each, with the box they divide; ``keys`` name a treelet, the cell last."""
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    own = PLANES.split(", ", 2)[2]
    names = [*keys, *(c.split()[0] for c in own.split(", "))]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        planes = treelet(rows[list(schema.positions)].to_numpy(np.float64), rows[schema.pid].to_numpy(), int(key[-1]))[4]
        return pd.DataFrame([(*key, *p) for p in planes], columns=names)

    return df.select(*keys, *schema.positions, schema.pid).groupBy(*keys).applyInPandas(run, ", ".join([*kinds, own]))


def node_table(df: DataFrame, schema: ParticleSchema, ranges: dict[str, tuple]) -> DataFrame:
    """Per subfile and cell: rows, box, levels, and range and bitmap of each attribute."""
    x, y, z = schema.positions
    aggs = [F.count(F.lit(1)).alias("n"), F.max("lod_level").alias("max_level")]
    aggs += [f(c).cast("double").alias(n) for n, f, c in (("lx", F.min, x), ("ly", F.min, y), ("lz", F.min, z), ("ux", F.max, x), ("uy", F.max, y), ("uz", F.max, z))]
    for a in schema.attrs:
        lo, hi = ranges[a]
        bits = bitmap.bit_of(F.col(a).cast("double"), float(lo), float(hi)) if lo is not None else F.lit(0).cast("long")
        aggs += [F.min(a).cast("double").alias(f"min_{a}"), F.max(a).cast("double").alias(f"max_{a}"), F.bit_or(bits).alias(f"bits_{a}")]
    keys = [c for c in (schema.timestep, "subfile", "cell") if c]
    return df.groupBy(*keys).agg(*aggs)


def subfile_table(nodes: DataFrame, schema: ParticleSchema, ranges: dict[str, tuple]) -> DataFrame:
    """Per subfile: what its cells have together, and the ranges that its bitmaps are on."""
    aggs = [F.sum("n").alias("n"), F.max("max_level").alias("max_level"), *[F.min(c).alias(c) for c in ("lx", "ly", "lz")], *[F.max(c).alias(c) for c in ("ux", "uy", "uz")]]
    for a in schema.attrs:
        lo, hi = (F.lit(None if v is None else float(v)).cast("double") for v in ranges[a])
        aggs += [F.min(f"min_{a}").alias(f"min_{a}"), F.max(f"max_{a}").alias(f"max_{a}"), F.bit_or(f"bits_{a}").alias(f"bits_{a}"), F.first(lo).alias(f"lo_{a}"), F.first(hi).alias(f"hi_{a}")]
    keys = [c for c in (schema.timestep, "subfile") if c]
    return nodes.groupBy(*keys).agg(*aggs)
