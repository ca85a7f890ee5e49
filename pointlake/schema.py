"""Which columns of a frame are positions, id, time step and attributes, and their types."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SCALARS: dict[str, tuple[T.DataType, int]] = {
    "INT_8": (T.ByteType(), 1), "INT_16": (T.ShortType(), 2), "INT_32": (T.IntegerType(), 4), "INT_64": (T.LongType(), 8),
    "UINT_8": (T.ShortType(), 1), "UINT_16": (T.IntegerType(), 2), "UINT_32": (T.LongType(), 4), "UINT_64": (T.DecimalType(20, 0), 8),
    "FLOAT_32": (T.FloatType(), 4), "FLOAT_64": (T.DoubleType(), 8),
}
#: Element names of vectors and matrices.
ELEMENTS = {"I8": "INT_8", "U8": "UINT_8", "I16": "INT_16", "U16": "UINT_16", "I32": "INT_32", "U32": "UINT_32", "FLOAT": "FLOAT_32", "DOUBLE": "FLOAT_64"}


def spark_type(dtype: str) -> T.DataType:
    """The Spark type of a data type's name, such as FLOAT_32, VEC3_FLOAT or MAT4_DOUBLE."""
    if dtype in SCALARS:
        return SCALARS[dtype][0]
    shape, _, element = dtype.partition("_")
    if shape in ("VEC2", "VEC3", "VEC4", "MAT2", "MAT3", "MAT4") and element in ELEMENTS:
        return T.ArrayType(SCALARS[ELEMENTS[element]][0], False)
    raise ValueError(f"unknown data type {dtype}")


def width(dtype: str) -> int:
    """Bytes of a value."""
    if dtype in SCALARS:
        return SCALARS[dtype][1]
    spark_type(dtype)
    shape, _, element = dtype.partition("_")
    n = int(shape[3])
    return SCALARS[ELEMENTS[element]][1] * (n if shape.startswith("VEC") else n * n)


def dtype_of(kind: T.DataType) -> str:
    """The data type's name of a Spark type; arrays and strings have none and are only carried."""
    for name in ("INT_8", "INT_16", "INT_32", "INT_64", "FLOAT_32", "FLOAT_64"):
        if SCALARS[name][0] == kind:
            return name
    return "UINT_64" if isinstance(kind, T.DecimalType) else "UNKNOWN"


@dataclass(frozen=True)
class ParticleSchema:
    """Roles of columns. ``attrs``: what can be queried by range; other columns are carried."""

    x: str = "x"
    y: str = "y"
    z: str = "z"
    pid: str = "pid"
    attrs: tuple[str, ...] = ()
    timestep: str | None = None
    dtypes: dict[str, str] = field(default_factory=dict, compare=False)

    @property
    def positions(self) -> tuple[str, str, str]:
        return self.x, self.y, self.z

    @classmethod
    def of(cls, df: DataFrame, pid: str = "pid", positions: tuple[str, str, str] = ("x", "y", "z"), timestep: str | None = None, attrs: tuple[str, ...] | None = None) -> "ParticleSchema":
        """From a frame: every other numeric column is an attribute unless ``attrs`` says which."""
        taken = {*positions, pid, timestep}
        kinds = {f.name: dtype_of(f.dataType) for f in df.schema}
        for c in positions:
            if kinds[c] not in ("FLOAT_32", "FLOAT_64"):
                raise ValueError(f"position column {c} must be FLOAT or DOUBLE")
        found = tuple(c for c, k in kinds.items() if c not in taken and k != "UNKNOWN") if attrs is None else tuple(attrs)
        for c in found:
            if kinds.get(c, "UNKNOWN") == "UNKNOWN":
                raise KeyError(f"attribute {c} does not exist or is not a number")
        return cls(*positions, pid, found, timestep, {c: kinds[c] for c in found})

    def bytes_per_row(self) -> int:
        """What a particle counts for a subfile's size: a position of three floats and its attributes."""
        return 12 + sum(width(self.dtypes.get(a, "FLOAT_32")) for a in self.attrs)

    def to_json(self) -> str:
        return json.dumps({"x": self.x, "y": self.y, "z": self.z, "pid": self.pid, "attrs": list(self.attrs), "timestep": self.timestep, "dtypes": self.dtypes})

    @classmethod
    def from_json(cls, text: str) -> "ParticleSchema":
        d = json.loads(text)
        return cls(d["x"], d["y"], d["z"], d["pid"], tuple(d["attrs"]), d["timestep"], d["dtypes"])
