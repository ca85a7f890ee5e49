"""Binary formats: raw dumps (.bp), cosmology bricks, LAS points.

The length and place of a file's rows are in its header, which a task reads first; the
rows are then read in ranges of RANGE_ROWS, each a task's work, by seeking to them. A file
of any size is as many tasks as it has ranges, and no task holds more than one range.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pointlake.functions.color import srgb_to_linear
from pointlake.schema import ParticleSchema, spark_type
from pointlake.storage import file_system

# Names of the formats' number types, and field layouts below.
NUMPY = {"INT_8": "<i1", "INT_16": "<i2", "INT_32": "<i4", "INT_64": "<i8", "UINT_8": "<u1", "UINT_16": "<u2", "UINT_32": "<u4", "UINT_64": "<u8", "FLOAT_32": "<f4", "FLOAT_64": "<f8"}
BATCH = 1 << 16
#: Rows that a task reads of a file at a time.
RANGE_ROWS = 1 << 22

Part = tuple[int, int, int, str]  # first row, rows, place in the file, what else the reader needs


class Slice:
    """A file opened for reading at places."""

    def __init__(self, address: str):
        files, path = file_system(address)
        self.file = files.open_input_file(path)

    def at(self, place: int, size: int) -> bytes:
        got = self.file.read_at(size, place)
        if len(got) < size:
            raise ValueError(f"a file of {self.file.size()} bytes ends before {place + size}")
        return got

    def values(self, kind: str, place: int, count: int) -> np.ndarray:
        return np.frombuffer(self.at(place, np.dtype(kind).itemsize * count), kind)

    def __enter__(self) -> "Slice":
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


def paths_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The files that a path or pattern names; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path")


def _batches(columns: list[np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(columns[0]), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(c[start : start + BATCH]).cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def by_rows(rows: int) -> list[Part]:
    return [(i, min(RANGE_ROWS, rows - i), 0, "") for i in range(0, rows, RANGE_ROWS)]


def in_parts(files: DataFrame, parts: Callable[[Slice], list[Part]], read: Callable[[str, Slice, Part], list[np.ndarray]], fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """The rows of all files: ``parts`` says from a file's header where they are, ``read`` gives the columns of one part."""
    kind = T.StructType([T.StructField(n, t) for n, t in fields])
    schema = to_arrow_schema(kind)
    work = pa.schema([("path", pa.string()), ("first", pa.int64()), ("rows", pa.int64()), ("place", pa.int64()), ("more", pa.string())])

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with Slice(path) as file:
                    yield pa.RecordBatch.from_pylist([dict(zip(work.names, (path, *part))) for part in parts(file)], work)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, *part in zip(*(c.to_pylist() for c in batch.columns)):
                with Slice(path) as file:
                    yield from _batches(read(path, file, tuple(part)), schema)

    tasks = files.sparkSession.sparkContext.defaultParallelism
    return files.mapInArrow(plan, "path string, first long, rows long, place long, more string").repartition(4 * tasks, "path", "first").mapInArrow(run, kind)


# ---- raw dumps -------------------------------------------------------------------


def bp_bytes(positions: np.ndarray, attrs: dict[str, tuple[str, np.ndarray]]) -> bytes:
    """u64 length, JSON header, positions as vec3 of floats, then each attribute's array."""
    blobs, at, described = [positions.astype("<f4").tobytes()], positions.shape[0] * 12, []
    for name, (dtype, values) in attrs.items():
        raw = values.astype(NUMPY[dtype]).tobytes()
        described.append({"name": name, "dtype": dtype, "offset": at, "size": len(raw)})
        blobs.append(raw)
        at += len(raw)
    header = json.dumps({"num_points": len(positions), "attributes": described}).encode()
    return struct.pack("<Q", len(header)) + header + b"".join(blobs)


def header(file: Slice) -> tuple[dict, int]:
    """A JSON header behind its length, and where it ends."""
    n = struct.unpack("<Q", file.at(0, 8))[0]
    return json.loads(file.at(8, n)), 8 + n


def first_header(files: DataFrame) -> dict:
    """The header of the first file by name."""
    first = files.orderBy("path").first()
    if first is None:
        raise FileNotFoundError("no file to read")
    with Slice(first.path) as file:
        return header(file)[0]


def read_bp(spark: SparkSession, path: str) -> DataFrame:
    """pid (place in its file), file, x, y, z and the attributes; all files have the first one's."""
    files = paths_of(spark, path)
    attrs = [(a["name"], a["dtype"]) for a in first_header(files)["attributes"]]
    fields = [("file", T.StringType()), ("pid", T.LongType()), *[(c, T.FloatType()) for c in "xyz"], *[(n, T.DecimalType(20, 0) if d == "UINT_64" else spark_type(d)) for n, d in attrs]]

    def read(name: str, file: Slice, part: Part) -> list[np.ndarray]:
        info, base = header(file)
        first, n, _, _ = part
        p = file.values("<f4", base + 12 * first, 3 * n).reshape(n, 3)
        places = {a["name"]: a["offset"] for a in info["attributes"]}
        columns = [file.values(NUMPY[d], base + places[a] + np.dtype(NUMPY[d]).itemsize * first, n) for a, d in attrs]
        return [np.full(n, name), first + np.arange(n), p[:, 0], p[:, 1], p[:, 2], *columns]

    return in_parts(files, lambda file: by_rows(header(file)[0]["num_points"]), read, fields)


def write_bp(df: DataFrame, folder: str, schema: ParticleSchema) -> DataFrame:
    """One raw dump per partition, named part-<n>.bp, in a folder that all workers share; returns the files' names and rows."""
    columns = [*schema.positions, *schema.attrs]
    dtypes = {a: schema.dtypes[a] for a in schema.attrs}
    kind = pa.schema([("name", pa.string()), ("rows", pa.int64())])
    positions = schema.positions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        number = lambda c: table.column(c).to_numpy() if not pa.types.is_decimal(table.column(c).type) else np.array([int(v) for v in table.column(c).to_pylist()], np.uint64)
        raw = bp_bytes(np.stack([number(c) for c in positions], axis=1), {a: (dtypes[a], number(a)) for a in dtypes})
        target, root = file_system(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}.bp"
        with target.open_output_stream(f"{root}/.{name}.{context.taskAttemptId()}", compression=None) as out:
            out.write(raw)
        target.move(f"{root}/.{name}.{context.taskAttemptId()}", f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([table.num_rows], pa.int64())], schema=kind)

    target, root = file_system(folder)
    target.create_dir(root, recursive=True)
    return df.select(*columns).mapInArrow(run, "name string, rows long")


# ---- cosmology bricks ------------------------------------------------------------

#: np, a, t, tau, nts, four steps, three checkpoints and a mass: twelve fields of four bytes.
COSMO_HEADER = np.dtype([("np", "<i4"), ("a", "<f4"), ("t", "<f4"), ("tau", "<f4"), ("nts", "<i4"), ("dt", "<f4", 3), ("cur", "<i4", 3), ("massp", "<f4")])
BRICK_SIDE = 768
BRICK_NAME = re.compile(r"xv(\d)(\d)(\d)\.dat$")


def read_cosmo(spark: SparkSession, path: str) -> DataFrame:
    """pid, file, x, y, z, v_x, v_y, v_z; positions are moved by their brick's place, which its name ends with."""

    rows_of = lambda file: int(file.values(COSMO_HEADER, 0, 1)[0]["np"])

    def read(name: str, file: Slice, part: Part) -> list[np.ndarray]:
        first, n, _, _ = part
        rows = file.values("<f4", COSMO_HEADER.itemsize + 24 * first, 6 * n).reshape(n, 6)
        place = BRICK_NAME.search(name)
        shift = np.array([BRICK_SIDE * int(g) for g in place.groups()] if place else [0, 0, 0], np.float32)
        moved = rows[:, :3] + shift
        return [np.full(n, name), first + np.arange(n), *(moved[:, i] for i in range(3)), *(rows[:, 3 + i] for i in range(3))]

    fields = [("file", T.StringType()), ("pid", T.LongType()), *[(c, T.FloatType()) for c in ("x", "y", "z", "v_x", "v_y", "v_z")]]
    return in_parts(paths_of(spark, path), lambda file: by_rows(rows_of(file)), read, fields)


# ---- LAS -------------------------------------------------------------------------

NOISE = 7
#: Where red begins in a point record, by format.
COLOR_AT = {2: 20, 3: 28, 5: 28}


def read_las(spark: SparkSession, path: str, keep_noise: bool = False) -> DataFrame:
    """pid, x, y, z about the cloud's centre, classification and linear colour (null without) of LAS 1.2 to 1.3 files."""
    numbers = [("x", T.DoubleType()), ("y", T.DoubleType()), ("z", T.DoubleType()), ("classification", T.IntegerType()), ("r", T.DoubleType()), ("g", T.DoubleType()), ("b", T.DoubleType()), *[(f"c{i}", T.DoubleType()) for i in range(3)]]

    def parts(file: Slice) -> list[Part]:
        if file.at(0, 4) != b"LASF":
            raise ValueError("not a LAS file")
        return by_rows(struct.unpack("<I", file.at(107, 4))[0])

    def read(_: str, file: Slice, part: Part) -> list[np.ndarray]:
        first, n, _, _ = part
        (start,) = struct.unpack("<I", file.at(96, 4))
        form, size = struct.unpack("<BH", file.at(104, 3))
        sx, sy, sz, ox, oy, oz, ux, lx, uy, ly, uz, lz = struct.unpack("<12d", file.at(131, 96))
        rows = file.values("u1", start + size * first, size * n).reshape(n, size)
        whole = rows[:, :12].copy().view("<i4")
        points = whole * np.array([sx, sy, sz]) + np.array([ox, oy, oz])
        at = COLOR_AT.get(form & 0x3F)
        colors = rows[:, at : at + 6].copy().view("<u2") / 65535.0 if at is not None else np.full((n, 3), np.nan)
        centre = [(lx + ux) / 2, (ly + uy) / 2, (lz + uz) / 2]
        return [first + np.arange(n), *(points[:, i] for i in range(3)), (rows[:, 15] & 0x1F).astype(np.int32), *(colors[:, i] for i in range(3)), *(np.full(n, c) for c in centre)]

    df = in_parts(paths_of(spark, path), parts, read, [("pid", T.LongType()), *numbers])
    df = df if keep_noise else df.where(F.col("classification") != NOISE)
    linear = [F.when(~F.isnan(c), srgb_to_linear(F.col(c))).cast("float").alias(c) for c in "rgb"]
    return df.select("pid", *[(F.col(c) - F.col(f"c{i}")).cast("float").alias(c) for i, c in enumerate("xyz")], "classification", *linear)
