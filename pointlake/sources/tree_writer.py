"""Writing tree files and aggregates of them: the binary layout that ``tree`` reads.

A subfile holds the rows of whole blocks of one grid, divided by a k-d tree whose planes
are planes of the grid, so that every plane separates its two sides. A file is a task's
work and held by it whole; blocks are not cut, so a block above a subfile's size makes a
file of its own size. Inside a file, cells of the Morton grid are leaves of a binary tree
over their codes' bits, and each has a k-d treelet (``layout.treelet``). Bitmaps of nodes
are on the file's own ranges, in the aggregate's header on those of all files.
"""

from __future__ import annotations

import itertools
import json
import math
import struct
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.functions import bitmap, lod, morton
from pointlake.functions.geometry import Box
from pointlake.operators import layout
from pointlake.plans import partition
from pointlake.schema import ParticleSchema
from pointlake.sources.binary import NUMPY
from pointlake.sources.tree import CODES, PAGE
from pointlake.storage import file_system

NUMBERS = {name: code for code, name in CODES.items()}
NO_ROWS = 0xFFFFFFFF


def codes_of(points: np.ndarray, box: Box) -> np.ndarray:
    """Morton codes of points on the grid over their box."""
    out = np.zeros(len(points), np.int64)
    for axis, (lo, side) in enumerate(zip(box.lower, box.diagonal)):
        at = np.floor(((1 << morton.BITS) - 1) * ((points[:, axis] - lo) / side)).astype(np.int64) if side > 0 else np.zeros(len(points), np.int64)
        for b in range(morton.BITS):
            out |= (at >> b & 1) << (3 * b + axis)
    return out


def cells_of(points: np.ndarray, box: Box) -> list[tuple[int, np.ndarray]]:
    """(code of the first grid place, rows) of each cell, in the order of the codes."""
    codes = codes_of(points, box)
    found, counts = np.unique(codes >> 3 * (morton.BITS - morton.COARSE_BITS), return_counts=True)
    low = 3 * (morton.BITS - morton.coarse_bits(dict(zip(found.tolist(), counts.tolist()))))
    cell = codes >> low
    return [(int(c) << low, np.flatnonzero(cell == c)) for c in np.unique(cell)]


@dataclass
class Treelet:
    points: np.ndarray
    values: dict[str, np.ndarray]
    nodes: np.ndarray  # three words a node
    bits: np.ndarray  # a bitmap a node and attribute
    depth: int


def treelet_of(points: np.ndarray, pids: np.ndarray, values: dict[str, np.ndarray], bits: np.ndarray, seed: int) -> Treelet:
    """Rows in the order of their nodes; nodes in preorder, a left child behind its parent."""
    if not len(points):
        return Treelet(points, values, np.array([[0, 3, NO_ROWS]], np.uint32), np.zeros((1, bits.shape[1]), np.int64), 0)
    level, node, idx, _, planes = layout.treelet(points.astype(np.float64), pids, seed)
    order = np.lexsort((idx, node))
    many = int(node.max()) + 1
    first = np.searchsorted(node[order], np.arange(many + 1))
    split = {p[0]: p for p in planes}
    nodes, size, own = np.zeros((many, 3), np.uint32), [1] * many, np.bitwise_or.reduceat(bits[order], first[:-1], axis=0)
    for i in reversed(range(many)):
        if i in split:
            left, right = i + 1, i + 1 + size[i + 1]
            size[i] += size[left] + size[right]
            own[i] |= own[left] | own[right]
            nodes[i] = np.float32(split[i][3]).view(np.uint32), right << 2 | split[i][2], first[i]
        else:
            nodes[i] = first[i], int(first[i + 1] - first[i]) << 2 | 3, NO_ROWS
    return Treelet(points[order], {k: v[order] for k, v in values.items()}, nodes, own, int(level.max()))


@dataclass
class Coarse:
    """Inner nodes over the cells: node ``i`` is one end of its range of cells, the root is 0."""

    links: list[int]
    planes: list[tuple[float, int]]
    bits: np.ndarray
    leaves: list[np.ndarray] = field(default_factory=list)


def coarse_of(starts: list[int], leaf_bits: list[np.ndarray], box: Box, halves: tuple[float, int] | None) -> Coarse:
    """The binary tree over cells by the highest bit in which a range of codes differs; ``halves``: the plane of two parts of one cell."""
    many = len(starts)
    out = Coarse([0] * (many - 1), [(0.0, 0)] * (many - 1), np.zeros((many - 1, len(leaf_bits[0])), np.int64))

    def made(i: int, lo: int, hi: int) -> np.ndarray:
        """Node ``i`` over the cells from ``lo`` to ``hi``; its bitmaps."""
        if halves is not None:
            at, plane = lo, halves
        else:
            bit = (starts[lo] ^ starts[hi]).bit_length() - 1
            edge = starts[hi] >> bit << bit
            at = next(k for k in range(lo, hi) if starts[k + 1] >= edge)  # the last cell below the edge
            axis = bit % 3
            place = sum((edge >> (3 * b + axis) & 1) << b for b in range(morton.BITS))
            plane = (box.lower[axis] + box.diagonal[axis] * place / ((1 << morton.BITS) - 1), axis)
        out.planes[i] = plane
        out.links[i] = at << 2 | (lo == at) | (hi == at + 1) << 1
        left = leaf_bits[at] if lo == at else made(at, lo, at)
        right = leaf_bits[hi] if hi == at + 1 else made(at + 1, at + 1, hi)
        out.bits[i] = left | right
        return out.bits[i]

    made(0, 0, many - 1)
    return out


def encoded(points: np.ndarray, pids: np.ndarray, attrs: dict[str, tuple[str, np.ndarray]]) -> tuple[bytes, dict]:
    """A tree file of some rows, at least one; and what an aggregate needs to know: box, rows, ranges and bitmaps."""
    points = points.astype("<f4")
    box = Box(tuple(map(float, points.min(axis=0))), tuple(map(float, points.max(axis=0))))
    values = {name: v.astype(NUMPY[kind]) for name, (kind, v) in attrs.items()}
    ranges = {name: (float(v.min()), float(v.max())) for name, v in values.items()}
    bits = np.zeros((len(points), len(attrs)), np.int64)
    for i, (name, (lo, hi)) in enumerate(ranges.items()):
        place = np.minimum(bitmap.BINS - 1, np.floor(bitmap.BINS * (values[name].astype(np.float64) - lo) / (hi - lo)).astype(np.int64)) if hi > lo else np.zeros(len(points), np.int64)
        bits[:, i] = np.int64(1) << place
    cells, halves = cells_of(points.astype(np.float64), box), None
    if len(cells) == 1:  # a tree has two leaves at least: halves on the longest axis, or all rows and none
        axis = box.axes_by_extent()[0]
        middle = float(np.sort(points[:, axis])[len(points) // 2])
        middle = middle if middle > box.lower[axis] else box.upper[axis]
        left = points[:, axis] < middle
        cells, halves = [(0, np.flatnonzero(left)), (1, np.flatnonzero(~left))], (middle, axis)
    parts = [treelet_of(points[rows], pids[rows], {k: v[rows] for k, v in values.items()}, bits[rows], start) for start, rows in cells]
    coarse = coarse_of([start for start, _ in cells], [p.bits[0] for p in parts], box, halves)

    used = Counter(coarse.bits.ravel().tolist())
    for p in parts:
        used.update(p.bits.ravel().tolist())
    ids = {b: i for i, (b, _) in enumerate(sorted(used.items(), key=lambda x: (-x[1], x[0])))}
    if len(ids) > 1 << 16:
        raise ValueError(f"{len(ids)} different bitmaps; a file can name {1 << 16}")
    named = lambda b: np.array([ids[x] for x in b.ravel().tolist()], "<u2").tobytes()

    head = b"".join(struct.pack("<QfI", link, *plane) for link, plane in zip(coarse.links, coarse.planes))
    tail = np.array(list(ids), "<u4").tobytes() + named(coarse.bits)
    blobs, offsets, at = [], [], len(head) + 8 * len(parts) + len(tail)
    for p in parts:
        pad = -at % PAGE
        offsets.append(at + pad)
        blob = struct.pack("<II", len(p.nodes), len(p.points)) + p.nodes.astype("<u4").tobytes() + named(p.bits) + p.points.tobytes() + b"".join(v.tobytes() for v in p.values.values())
        blobs += [bytes(pad), blob]
        at += pad + len(blob)
    least = math.ceil(math.log2(len(parts))) + 1
    info = {
        "bounds": [*box.lower, *box.upper], "num_nodes": len(coarse.links), "num_treelets": len(parts), "bitmap_dict_size": len(ids), "num_points": len(points),
        "num_lod_prims": lod.NODE_ROWS, "min_lod": least, "max_lod": least + max(p.depth for p in parts) + 1,
        "attributes": [{"name": n, "dtype": NUMBERS[attrs[n][0]], "range": list(r)} for n, r in ranges.items()],
    }
    text = json.dumps(info).encode()
    raw = struct.pack("<Q", len(text)) + text
    raw += bytes(-len(raw) % PAGE) + head + np.array(offsets, "<u8").tobytes() + tail + b"".join(blobs)
    about = {"rows": len(points), "lower": list(box.lower), "upper": list(box.upper), "lo": [r[0] for r in ranges.values()], "hi": [r[1] for r in ranges.values()], "bits": [int(b) for b in coarse.bits[0]]}
    return raw, about


@dataclass
class Node:
    """A node of the division into subfiles: a plane, or the number of a subfile."""

    axis: int = 3
    position: float = 0.0
    subfile: int = -1
    right: int = -1


def divided(blocks: list[partition.Block], most: int) -> tuple[list[Node], dict[int, int]]:
    """Nodes in preorder over blocks given by their grid places, and the subfile of each block; sides never share a place."""
    nodes: list[Node] = []
    of: dict[int, int] = {}
    leaves = itertools.count()

    def made(part: list[partition.Block]) -> None:
        _, _, axes = partition.extent(part)
        split = partition.best_split(part, axes) if sum(b.rows for b in part) > most else None
        if split is None:
            nodes.append(Node(subfile=next(leaves)))
            of.update({b.id: nodes[-1].subfile for b in part})
            return
        _, axis, position = split
        nodes.append(Node(axis, position))
        mine = len(nodes) - 1
        made([b for b in part if b.corner[axis] < position])
        nodes[mine].right = len(nodes)
        made([b for b in part if b.corner[axis] >= position])

    made(blocks)
    return nodes, of


def _header(nodes: list[Node], about: dict[int, dict], attrs: list[tuple[str, str]], name: str, box: Box, edges) -> bytes:
    """The aggregate's header: nodes, dictionary and bitmaps on the ranges of all subfiles."""
    ranges = [(min(a["lo"][i] for a in about.values()), max(a["hi"][i] for a in about.values())) for i in range(len(attrs))]
    bits = [[0] * len(attrs) for _ in nodes]
    for n in reversed(range(len(nodes))):
        if nodes[n].axis == 3:
            a = about[nodes[n].subfile]
            bits[n] = [bitmap.remapped(b, (lo, hi), whole) for b, lo, hi, whole in zip(a["bits"], a["lo"], a["hi"], ranges)]
        else:
            bits[n] = [x | y for x, y in zip(bits[n + 1], bits[nodes[n].right])]
    used = Counter(b for row in bits for b in row)
    ids = {b: i for i, (b, _) in enumerate(sorted(used.items(), key=lambda x: (-x[1], x[0])))}
    words = b"".join(struct.pack("<II", n.subfile, 3) if n.axis == 3 else struct.pack("<fI", edges(n.axis, n.position), n.right << 2 | n.axis) for n in nodes)
    info = {
        "bounds": [*box.lower, *box.upper], "num_nodes": len(nodes), "num_aggregators": len(about), "num_sim_ranks": len(about), "num_points": sum(a["rows"] for a in about.values()),
        "bat_prefix": name, "bitmap_dict_size": len(ids), "attributes": [{"name": n, "dtype": NUMBERS[d], "range": list(r)} for (n, d), r in zip(attrs, ranges)],
    }
    text = json.dumps(info).encode()
    return struct.pack("<Q", len(text)) + text + words + np.array(list(ids), "<u4").tobytes() + np.array([ids[b] for row in bits for b in row], "<u2").tobytes()


def _put(address: str, raw: bytes) -> None:
    """A file that is there whole or not at all."""
    files, path = file_system(address)
    folder, _, name = path.rpartition("/")
    files.create_dir(folder, recursive=True)
    held = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(held, compression=None) as out:
        out.write(raw)
    files.move(held, path)


def write_trees(df: DataFrame, folder: str, schema: ParticleSchema, name: str = "particles", bytes_per_subfile: int = 256 << 20) -> int:
    """Write ``df`` as tree files ``name``<n>.bat and the header of their aggregate, ``name``.pbat; returns the number of files.

    Positions become 32-bit floats; rows without a whole position are left out, as no box holds them.
    An empty table writes nothing.
    """
    spark, attrs = df.sparkSession, [(a, schema.dtypes[a]) for a in schema.attrs]
    rows = df.select(F.col(schema.pid).alias("__pid"), *[F.col(c).cast("float").alias(f"__{a}") for a, c in zip("xyz", schema.positions)], *[F.col(a) for a, _ in attrs])
    x, y, z = F.col("__x"), F.col("__y"), F.col("__z")
    rows = rows.where(~F.isnan(x) & ~F.isnan(y) & ~F.isnan(z))
    box, n = layout.bounds_and_rows(rows, ParticleSchema("__x", "__y", "__z", "__pid"))
    if not n:
        return 0
    most = partition.capacity(bytes_per_subfile, schema.bytes_per_row())
    bits = layout.block_bits(n, most)
    rows = rows.withColumn("__block", morton.cell(morton.morton3(x, y, z, box), bits))
    counts = rows.groupBy("__block").count().collect()  # at most the blocks of the grid
    place = lambda code, axis: float(sum((code >> (3 * b + axis) & 1) << b for b in range(bits)))
    nodes, of = divided([partition.Block(r["__block"], tuple(place(r["__block"], a) for a in range(3)), r["count"]) for r in sorted(counts, key=lambda r: r["__block"])], most)
    step = 1 << morton.BITS - bits

    def edge(axis: int, position: float) -> float:
        return box.lower[axis] + box.diagonal[axis] * position * step / ((1 << morton.BITS) - 1)

    table = spark.createDataFrame(list(of.items()), "__block long, __subfile int")
    placed = rows.join(F.broadcast(table), "__block").drop("__block")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        number = lambda c: rows.column(c).to_numpy() if not pa.types.is_decimal(rows.column(c).type) else np.array([int(v) for v in rows.column(c).to_pylist()], np.uint64)
        points = np.stack([number(f"__{a}") for a in "xyz"], axis=1)
        raw, about = encoded(points, number("__pid"), {a: (d, number(a)) for a, d in attrs})
        _put(f"{folder}/{name}{key[0].as_py()}.bat", raw)
        return pa.table({"subfile": pa.array([key[0].as_py()], pa.int32()), "about": [json.dumps(about)]})

    made = placed.groupBy("__subfile").applyInArrow(run, "subfile int, about string").collect()  # a row a file
    about = {r.subfile: json.loads(r.about) for r in made}
    _put(f"{folder}/{name}.pbat", _header(nodes, about, attrs, name, box, edge))
    return len(about)
