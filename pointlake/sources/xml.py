"""XML formats: simulation archives with raw side files (UDA) and unstructured grids (VTU).

The driver reads the small XML and makes a list of byte ranges; tasks read the ranges.
"""

from __future__ import annotations

import base64
import re
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pointlake.sources.binary import Slice

# Names of the formats' number types.
UDA_TYPES = {"double": "f8", "float": "f4", "long64": "i8"}
SPARK_TYPES = {"f8": T.DoubleType(), "f4": T.FloatType(), "i8": T.LongType()}
VTK_TYPES = {"Int8": "i1", "UInt8": "u1", "Int16": "i2", "UInt16": "u2", "Int32": "i4", "UInt32": "u4", "Int64": "i8", "UInt64": "u8", "Float32": "f4", "Float64": "f8"}


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def uda_variables(spark: SparkSession, timestep: str) -> tuple[list[dict], str]:
    """The particle variables of a time step's data files, and the byte order."""
    root = ET.fromstring(_text(spark, timestep))
    folder = timestep.rsplit("/", 1)[0]
    order = "<" if "little" in (root.findtext("./Meta/endianness") or "little_endian") else ">"
    if root.tag == "Uintah_Output":
        parts = [(folder, root)]
    else:
        parts = [(f"{folder}/{d.get('href')}".rsplit("/", 1)[0], ET.fromstring(_text(spark, f"{folder}/{d.get('href')}"))) for d in root.findall("./Data/Datafile")]
    out = []
    for place, doc in parts:
        for v in doc.findall("./Variable"):
            kind = re.match(r"ParticleVariable<(\w+)>", v.get("type", ""))
            get = lambda name, v=v: (v.findtext(name) or "").strip()
            if kind:
                out.append({"name": get("variable"), "type": kind[1], "file": f"{place}/{get('filename')}", "start": int(get("start")), "end": int(get("end")), "patch": int(get("patch")), "n": int(get("numParticles"))})
    return out, order


def read_uda(spark: SparkSession, timestep: str) -> DataFrame:
    """pid, patch, x, y, z and the scalar variables of a time step; ``p.x`` (double points) becomes float positions.

    Variables of other types are left out. Each patch is one task's work.
    """
    found, order = uda_variables(spark, timestep)
    scalars = sorted({(v["name"], UDA_TYPES[v["type"]]) for v in found if v["type"] in UDA_TYPES})
    patches = sorted({v["patch"] for v in found if v["name"] == "p.x" and v["n"] > 0})
    kind = T.StructType([T.StructField("pid", T.LongType()), T.StructField("patch", T.IntegerType()), *[T.StructField(c, T.FloatType()) for c in "xyz"], *[T.StructField(n, SPARK_TYPES[t]) for n, t in scalars]])
    if not patches:
        return spark.createDataFrame([], kind)
    ranges = [(v["patch"], v["name"], "point" if v["name"] == "p.x" else UDA_TYPES.get(v["type"], ""), v["file"], v["start"], v["end"], v["n"]) for v in found if v["name"] == "p.x" or v["type"] in UDA_TYPES]
    before = {}
    for p in patches:
        before[p] = sum(v["n"] for v in found if v["name"] == "p.x" and v["patch"] < p)
    work = spark.createDataFrame(ranges, "patch int, name string, kind string, file string, start long, end long, n long")
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = {r["name"]: r for r in table.to_pylist()}
        for r in rows.values():
            with Slice(r["file"]) as file:
                r["raw"] = file.at(r["start"], r["end"] - r["start"])
        n = rows["p.x"]["n"]
        p = np.frombuffer(rows["p.x"]["raw"], f"{order}f8", 3 * n).reshape(n, 3).astype(np.float32)
        columns = [np.arange(n) + before[key[0].as_py()], np.full(n, key[0].as_py(), np.int32), p[:, 0], p[:, 1], p[:, 2]]
        arrays = [pa.array(c) for c in columns]
        for name, t in scalars:
            arrays.append(pa.array(np.frombuffer(rows[name]["raw"], f"{order}{t}", n).astype(t)) if name in rows else pa.nulls(n))
        return pa.Table.from_arrays([a.cast(f) for a, f in zip(arrays, kinds)], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds, names = to_arrow_schema(kind).types, kind.names
    return work.groupBy("patch").applyInArrow(run, kind)  # a task reads the byte ranges of its patch; files are never moved


def _array(node: ET.Element, appended: bytes, order: str, header: str, packed: bool, raw: bool) -> np.ndarray:
    """Values of a DataArray: ascii, binary (base64) or appended (raw or base64), plain or compressed."""
    kind = order + VTK_TYPES[node.get("type")]
    if node.get("format") == "ascii":
        return np.array((node.text or "").split(), np.float64).astype(kind)
    if node.get("format") == "appended":
        data = appended[int(node.get("offset")) :]
    else:
        data, raw = (node.text or "").strip().encode(), False
    word = np.dtype(order + VTK_TYPES[header]).itemsize
    whole = lambda b, n: b[:n] if raw else base64.b64decode(b[: -(-n // 3) * 4])[:n]
    number = lambda b: np.frombuffer(b, order + VTK_TYPES[header])
    if not packed:
        n = int(number(whole(data, word))[0])
        return np.frombuffer(whole(data, word + n)[word:], kind)
    blocks = int(number(whole(data, word))[0])
    head = number(whole(data, word * (3 + blocks)))
    at = word * (3 + blocks) if raw else -(-word * (3 + blocks) // 3) * 4
    body, out, p = whole(data[at:], int(head[3:].sum())), [], 0
    for size in head[3:]:
        out.append(zlib.decompress(body[p : p + int(size)]))
        p += int(size)
    return np.frombuffer(b"".join(out), kind)


def vtu_columns(content: bytes) -> dict[str, np.ndarray]:
    """x, y, z and the point data of a .vtu document; vectors as name_0, name_1 and so on."""
    start = content.find(b"<AppendedData")
    appended, raw = b"", False
    if start >= 0:
        raw = b'encoding="raw"' in content[start : content.index(b">", start)]
        begin = content.index(b"_", content.index(b">", start)) + 1
        end = content.rindex(b"</AppendedData>")
        appended, content = content[begin:end], content[: content.index(b">", start) + 1] + content[end:]
    root = ET.fromstring(content)
    order = ">" if root.get("byte_order") == "BigEndian" else "<"
    args = (appended, order, root.get("header_type", "UInt32"), root.get("compressor") is not None, raw)
    out: dict[str, list[np.ndarray]] = {}
    for piece in root.iter("Piece"):
        n = int(piece.get("NumberOfPoints"))
        points = _array(piece.find("./Points/DataArray"), *args).reshape(n, 3).astype(np.float32)
        for i, c in enumerate("xyz"):
            out.setdefault(c, []).append(points[:, i])
        for a in piece.findall("./PointData/DataArray"):
            values, parts = _array(a, *args), int(a.get("NumberOfComponents", 1))
            for i in range(parts):
                out.setdefault(a.get("Name") + (f"_{i}" if parts > 1 else ""), []).append(values.reshape(n, parts)[:, i])
    return {k: np.concatenate(v) for k, v in out.items()}


def read_vtu(spark: SparkSession, path: str) -> DataFrame:
    """file, pid and the columns of each .vtu file; all files have the first one's columns."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    first = vtu_columns(bytes(files.orderBy("path").first().content))
    narrow = {"i": {1: T.ByteType(), 2: T.ShortType(), 4: T.IntegerType(), 8: T.LongType()}, "u": {1: T.ShortType(), 2: T.IntegerType(), 4: T.LongType(), 8: T.DecimalType(20, 0)}, "f": {4: T.FloatType(), 8: T.DoubleType()}}
    kind = T.StructType([T.StructField("file", T.StringType()), T.StructField("pid", T.LongType()), *[T.StructField(k, narrow[v.dtype.kind][v.dtype.itemsize]) for k, v in first.items()]])
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, names = to_arrow_schema(kind), list(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                got = vtu_columns(content.as_py())
                n = len(got["x"])
                arrays = [pa.array([name.as_py()] * n), pa.array(np.arange(n)), *[pa.array(got[c].astype(got[c].dtype.newbyteorder("="))) for c in names]]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

    return files.mapInArrow(run, kind)
