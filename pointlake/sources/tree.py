"""Tree files: the binary layout with a header in JSON, coarse nodes and page-aligned treelets.

Only rows and their place in the tree are read; ``tree_writer`` writes them.
A treelet of a file, or of one of the files an aggregate header lists, is one task's work.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pointlake.schema import SCALARS
from pointlake.sources.binary import NUMPY, Part, Slice, first_header, header, in_parts, paths_of
from pointlake.storage import names

# Numbers of the scalar types in headers, from 1, and sizes of nodes.
CODES = dict(enumerate(("INT_8", "UINT_8", "INT_16", "UINT_16", "INT_32", "UINT_32", "INT_64", "UINT_64", "FLOAT_32", "FLOAT_64"), 1))
PAGE, COARSE_NODE, KD_NODE = 4096, 16, 12


def _attributes(info: dict) -> list[tuple[str, str]]:
    return [(a["name"], CODES[a["dtype"]]) for a in info.get("attributes") or []]


def places(file: Slice) -> list[Part]:
    """Where each treelet is: rows before it, its rows, its place and number."""
    info, at = header(file)
    base = -(-at // PAGE) * PAGE
    offsets = file.values("<u8", base + COARSE_NODE * info["num_nodes"], info["num_treelets"]).tolist()
    out, first = [], 0
    for i, offset in enumerate(offsets):
        n = struct.unpack("<I", file.at(base + offset + 4, 4))[0]
        out.append((first, n, base + offset, str(i)))
        first += n
    return out


def treelet(file: Slice, place: int) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Positions, attributes, and the depth of the node that owns each row of the treelet at ``place``."""
    info, _ = header(file)
    attrs = _attributes(info)
    nodes, n = struct.unpack("<II", file.at(place, 8))
    at = place + 8
    kd = file.values("<u4", at, 3 * nodes).reshape(nodes, 3)
    at += nodes * (KD_NODE + len(attrs) * (2 + 8 * bool(info.get("has_ranges"))))
    points = file.values("<f4", at, 3 * n).reshape(n, 3)
    at += 12 * n
    values = {}
    for name, dtype in attrs:
        values[name] = file.values(NUMPY[dtype], at, n)
        at += values[name].nbytes
    return points, values, _levels(kd, n, info["num_lod_prims"])


def _levels(kd: np.ndarray, n: int, lod_rows: int) -> np.ndarray:
    """Depth by row: a leaf's rows at its depth, the rows an inner node shows at that node's."""
    level, todo = np.zeros(n, np.int32), [(0, 0)] if len(kd) else []
    while todo:
        i, depth = todo.pop()
        first, info, shown = (int(v) for v in kd[i])
        if info & 3 == 3:
            level[first : first + (info >> 2)] = depth
        else:
            if shown != 0xFFFFFFFF:
                level[shown : shown + lod_rows] = depth
            todo += [(info >> 2, depth + 1), (i + 1, depth + 1)]
    return level


def read_tree(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, pid (place in its file), treelet, lod_level, x, y, z and the attributes of the first file."""
    files = paths_of(spark, path)
    attrs = _attributes(first_header(files))
    fields = [("file", T.StringType()), ("pid", T.LongType()), ("treelet", T.IntegerType()), ("lod_level", T.IntegerType()), *[(c, T.FloatType()) for c in "xyz"], *[(a, SCALARS[d][0]) for a, d in attrs]]

    def read(name: str, file: Slice, part: Part) -> list[np.ndarray]:
        first, n, place, number = part
        points, values, levels = treelet(file, place)
        return [np.full(n, name), first + np.arange(n), np.full(n, int(number), np.int32), levels, *(points[:, i] for i in range(3)), *(values[a] for a, _ in attrs)]

    return in_parts(files, places, read, fields)


def subfile_ids(file: Slice) -> list[int]:
    """The subfiles that an aggregate's leaves name: nodes of a number and a word whose two low bits mark leaves."""
    info, at = header(file)
    nodes = file.values("<u4", at, 2 * info["num_nodes"]).reshape(-1, 2)
    return sorted(nodes[nodes[:, 1] & 3 == 3, 0].tolist())


def read_aggregate(spark: SparkSession, path: str) -> DataFrame:
    """The subfiles that an aggregate header lists (all there are, if it lists none); empty ones have no file."""
    address = paths_of(spark, path).first().path
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    with Slice(address) as file:
        info, _ = header(file)
        ids = subfile_ids(file) if info.get("num_nodes") else None
    if ids is None:
        return read_tree(spark, f"{folder}/{info['bat_prefix']}*.bat")
    there = set(names(spark, folder))
    return read_tree(spark, [f"{folder}/{name}" for i in ids if (name := f"{info['bat_prefix']}{i}.bat") in there])


def open_tree(spark: SparkSession, path: str) -> DataFrame:
    """A single tree, or an aggregate of trees, by its extension."""
    return read_tree(spark, path) if path.endswith(".bat") else read_aggregate(spark, path)
