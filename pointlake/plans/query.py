"""The query: box, attribute ranges and a quality interval, compiled to column predicates.

Predicates compare columns in their own type and are never wrapped in casts, so that
Parquet row groups are skipped by their statistics.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions.geometry import Box
from pointlake.schema import ParticleSchema

Range = tuple[float, float]


def in_ranges(column: Column, ranges: Sequence[Range], strict_empty: bool = False) -> Column:
    """In any of some closed ranges. No range restricts nothing, or nothing passes if ``strict_empty``."""
    if not ranges:
        return F.lit(not strict_empty)
    return reduce(lambda a, b: a | b, [(column >= F.lit(lo)) & (column <= F.lit(hi)) for lo, hi in ranges])


@dataclass(frozen=True)
class QuerySpec:
    """What to return. ``box`` None: the whole table; ``quality`` 1: every row.

    An attribute's name may be a column, ``column[i]`` for an element of an
    array (from 0) or ``|a,b,c|`` for the magnitude of up to three columns.
    """

    box: Box | None = None
    attrs: dict[str, Sequence[Range]] = field(default_factory=dict)
    prev_quality: float = 0.0
    quality: float = 1.0
    columns: Sequence[str] | None = None
    prune: frozenset[str] = frozenset({"range", "bitmap"})
    timestep: int | None = None
    strict_empty: bool = False

    @classmethod
    def from_json(cls, text: str) -> "QuerySpec":
        """``{"attributes": [{"name", "range": [[lo, hi], ...]}], "bounds": [[lo], [hi]]}``"""
        d = json.loads(text)
        box = Box(*(tuple(float(v) for v in corner) for corner in d["bounds"])) if "bounds" in d else None
        return cls(box, {a["name"]: [tuple(r) for r in a["range"]] for a in d.get("attributes", [])})

    @classmethod
    def from_server_json(cls, text: str, schema: ParticleSchema) -> "QuerySpec":
        """``quality`` (0.1), ``prev_quality`` (0), ``attribute``, ``range_min``, ``range_max``.

        An attribute that is absent or unknown stands for the first one, without
        a range; the columns are the position and that attribute.
        """
        d = json.loads(text)
        name = d.get("attribute")
        known = name in schema.attrs
        attr = name if known else schema.attrs[0] if schema.attrs else None
        inf = float("inf")
        ranges = {attr: [(float(d.get("range_min", -inf)), float(d.get("range_max", inf)))]} if known and ("range_min" in d or "range_max" in d) else {}
        return cls(None, ranges, float(d.get("prev_quality", 0.0)), float(d.get("quality", 0.1)), [*schema.positions, *([attr] if attr else [])])

    def same_filter(self, other: "QuerySpec") -> bool:
        return replace(self, quality=0, prev_quality=0) == replace(other, quality=0, prev_quality=0)

    def value(self, name: str, schema: ParticleSchema, df: DataFrame) -> Column:
        if name.startswith("|") and name.endswith("|"):
            parts = [F.col(p.strip()) for p in name[1:-1].split(",")]
            return F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))
        if name.endswith("]") and name.partition("[")[0] in df.columns:
            column, _, index = name[:-1].partition("[")
            return F.get(F.col(column), int(index))
        if name not in df.columns:
            raise KeyError(f"request for attribute {name} which does not exist")
        return F.col(name)

    def predicate(self, schema: ParticleSchema, df: DataFrame) -> Column:
        tests = [] if self.box is None else [self.box.contains(*map(F.col, schema.positions))]
        tests += [in_ranges(self.value(name, schema, df), ranges, self.strict_empty) for name, ranges in self.attrs.items()]
        if self.timestep is not None and schema.timestep:
            tests.append(F.col(schema.timestep) == self.timestep)
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def run(df: DataFrame, spec: QuerySpec, schema: ParticleSchema) -> DataFrame:
    """The rows of a frame without a layout: filters and columns, at full quality."""
    out = df.where(spec.predicate(schema, df))
    return out if spec.columns is None else out.select(*spec.columns)
