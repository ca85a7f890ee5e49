"""Particle tables: opening, querying, refining and inspecting what the writer laid out."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointlake.functions import bitmap, lod
from pointlake.functions.geometry import Box
from pointlake.operators import layout
from pointlake.operators.writer import latest
from pointlake.plans.query import QuerySpec, Range, run
from pointlake.schema import ParticleSchema
from pointlake.storage import read_text

#: Runs of subfiles in a filter, at most; more of them are joined as a table, which is broadcast up to MOST_BROADCAST rows.
MOST_LISTED = 1000
#: Rows of a part of a binary answer, at most.
ANSWER_ROWS = 1 << 16
#: Columns of the layout, which a query does not return unless they are named.
LAYOUT = ("morton", "cell", "version", "subfile", "lod_level", "lod_node", "lod_idx", "lod_cnt")


class ParticleTable:
    """A table with or without a layout.

    With one, a query first drops subfiles by their metadata (one row each, read
    once): by box, by attribute range and by value bitmap. What is left becomes a
    partition filter beside the row predicates.
    """

    def __init__(self, df: DataFrame, schema: ParticleSchema, subfiles: DataFrame | None = None, nodes: DataFrame | None = None, ranges: dict[str, Range] | None = None):
        self.df, self.schema, self.subfiles_df, self.nodes_df = df, schema, subfiles, nodes
        self._ranges = ranges
        self._meta: list | None = None

    @classmethod
    def from_df(cls, df: DataFrame, schema: ParticleSchema | None = None) -> "ParticleTable":
        return cls(df, schema or ParticleSchema.of(df))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "ParticleTable":
        """The table as the latest commit says; later saves do not change it."""
        _, steps, versions = latest(spark, path)
        if not versions:
            raise FileNotFoundError(f"no commit in {path}")
        info = {v: json.loads(read_text(spark, f"{path}/versions/{v}.json")) for v in versions}
        newest = info[versions[-1]]
        schema = ParticleSchema.from_json(json.dumps(newest["schema"]))
        def read(part: str) -> DataFrame:
            kind = T.StructType.fromJson(json.loads(newest["kinds"][part]))
            kind = T.StructType([*kind.fields, T.StructField("version", T.StringType())])
            found = spark.read.schema(kind).option("basePath", f"{path}/{part}").parquet(*[f"{path}/{part}/version={v}" for v in versions])
            return found.where(_live(schema, steps, info))

        return cls(read("data"), schema, read("subfiles"), read("nodes"))

    @property
    def attributes(self) -> tuple[str, ...]:
        return self.schema.attrs

    def describe_attribute(self, i: int) -> dict:
        name = self.schema.attrs[i]
        lo, hi = self.ranges()[name]
        return {"name": name, "dtype": self.schema.dtypes.get(name, "UNKNOWN"), "range": [lo, hi]}

    def ranges(self) -> dict[str, tuple]:
        """Smallest and largest value by attribute, of subfiles' metadata where there is any."""
        if self._ranges is None and self.subfiles_df is None:
            self._ranges = layout.attribute_ranges(self.df, self.schema.attrs)
        elif self._ranges is None:
            self._ranges = {}
            for a in self.schema.attrs:
                ends = [(r[f"min_{a}"], r[f"max_{a}"]) for r in self._subfiles() if r[f"min_{a}"] is not None]
                self._ranges[a] = (min(e[0] for e in ends), max(e[1] for e in ends)) if ends else (None, None)
        return self._ranges

    def bounds(self) -> Box:
        if self.subfiles_df is None:
            return layout.bounds_of(self.df, self.schema)
        return reduce(Box.union, [_box(r) for r in self._subfiles()], Box())

    def num_points(self) -> int:
        return self.df.count() if self.subfiles_df is None else sum(r.n for r in self._subfiles())

    def _subfiles(self) -> list:
        if self._meta is None:
            self._meta = self.subfiles_df.collect()
        return self._meta

    def subfiles(self, box: Box) -> list[int]:
        """Subfiles whose box touches ``box``."""
        return sorted({r.subfile for r in self._subfiles() if _box(r).overlaps(box)})

    def nodes(self) -> DataFrame:
        return self.nodes_df

    def iterate_subfiles(self, fn: Callable) -> None:
        for r in self._subfiles():
            fn(r)

    def _kept(self, spec: QuerySpec) -> list:
        out = []
        for r in self._subfiles():
            if spec.box is not None and not _box(r).overlaps(spec.box) or spec.timestep is not None and self.schema.timestep and r[self.schema.timestep] != spec.timestep:
                continue
            if all(self._may_hold(r, name, ranges, spec) for name, ranges in spec.attrs.items() if name in self.schema.attrs):
                out.append(r)
        return out

    def _may_hold(self, r, name: str, ranges, spec: QuerySpec) -> bool:
        lo, hi = r[f"min_{name}"], r[f"max_{name}"]
        if not ranges:
            return not spec.strict_empty
        if lo is None:
            return False
        if "range" in spec.prune and not any(a <= hi and b >= lo for a, b in ranges):
            return False
        return "bitmap" not in spec.prune or bool(r[f"bits_{name}"] & bitmap.mask_of(ranges, (r[f"lo_{name}"], r[f"hi_{name}"])))

    def query(self, spec: QuerySpec) -> DataFrame:
        """The rows of a query. Which rows a quality has depends on the layout only."""
        if self.subfiles_df is None:
            if spec.quality < 1 or spec.prev_quality > 0:
                raise ValueError("a quality below 1 needs a table with a layout")
            return run(self.df, spec, self.schema)
        where = spec.predicate(self.schema, self.df)
        columns = list(spec.columns) if spec.columns is not None else [c for c in self.df.columns if c not in LAYOUT]
        out = self._pruned(spec, self._kept(spec))
        return out.where(where).select(*columns)

    def _place(self, r) -> tuple:
        """What names a subfile among all: version, time step, number."""
        return (r.version, str(r[self.schema.timestep]) if self.schema.timestep else None, r.subfile)

    def _pruned(self, spec: QuerySpec, kept: list) -> DataFrame:
        """The rows of the kept subfiles that are in the interval of levels, which differs by a subfile's deepest one."""
        if not kept or spec.quality <= spec.prev_quality:
            return self.df.where(F.lit(False))
        whole = spec.quality >= 1 and spec.prev_quality <= 0
        if whole and len(kept) == len(self._subfiles()):
            return self.df
        # runs of subfiles that one deepest level holds for
        runs: list[list] = []
        for r in sorted(kept, key=self._place):
            v, t, n = self._place(r)
            level = None if whole else r.max_level
            if runs and runs[-1][:2] == [v, t] and runs[-1][4] == level and runs[-1][3] == n - 1:
                runs[-1][3] = n
            else:
                runs.append([v, t, n, n, level])
        level_of = lambda m: F.lit(True) if m is None else lod.interval(spec.prev_quality, spec.quality, m, F.col("lod_level"), F.col("lod_idx"), F.col("lod_cnt"))
        step = self.schema.timestep
        if len(runs) <= MOST_LISTED:
            # partition columns, so that only paths are tested
            tests: dict = {}
            for v, t, lo, hi, m in runs:
                here = F.col("subfile").between(lo, hi) if lo < hi else F.col("subfile") == lo
                tests.setdefault(m, {}).setdefault((v, t), []).append(here)
            parts = []
            for m, by in tests.items():
                places = [(F.col("version") == v) & (F.lit(True) if step is None else F.col(step).cast("string") == t) & reduce(lambda a, b: a | b, here) for (v, t), here in by.items()]
                parts.append(reduce(lambda a, b: a | b, places) & level_of(m))
            return self.df.where(reduce(lambda a, b: a | b, parts))
        spark = self.df.sparkSession
        listed = spark.createDataFrame([(*self._place(r), r.max_level) for r in kept], "version string, __step string, subfile int, __deepest int")
        listed = F.broadcast(listed) if len(kept) <= layout.MOST_BROADCAST else listed
        same = ["version", "subfile"]
        rows = self.df if step is None else self.df.withColumn("__step", F.col(step).cast("string"))
        out = rows.join(listed if step else listed.drop("__step"), [*same, "__step"] if step else same)
        if not whole:
            levels = sorted({r.max_level for r in kept})
            out = out.where(reduce(lambda a, b: a | b, [(F.col("__deepest") == m) & level_of(m) for m in levels]))
        return out.drop("__deepest", "__step")

    def split_planes(self, spec: QuerySpec) -> DataFrame:
        """Planes that treelets are split at, of subfiles and cells that a query's box and ranges leave, as deep as its quality goes.

        The table keeps rows, not planes: those of the kept cells are worked out
        again from positions and ids. A plane is returned if the box it divides
        touches the query's.
        """
        cells = self.nodes_df
        if spec.box is not None:
            cells = cells.where(spec.box.overlap(*map(F.col, ("lx", "ly", "lz", "ux", "uy", "uz"))))
        for a, ranges in spec.attrs.items():
            if a not in self.schema.attrs:
                raise KeyError(f"request for attribute {a} which does not exist")
            if ranges:
                cells = cells.where(reduce(lambda p, q: p | q, [(F.col(f"min_{a}") <= hi) & (F.col(f"max_{a}") >= lo) for lo, hi in ranges]))
        keys = [c for c in (self.schema.timestep, "version", "subfile", "cell") if c]
        kept = self._kept(spec)
        rows = self._pruned(replace(spec, quality=1.0, prev_quality=0.0), kept).select(*keys, *self.schema.positions, self.schema.pid)
        planes = layout.split_planes(rows.join(cells.select(*keys), keys, "left_semi"), self.schema, keys)
        deepest = self.subfiles_df.select(*keys[:-1], "max_level")
        planes = planes.join(deepest, keys[:-1]).where(F.col("level") <= F.floor(F.lit(lod.remap_quality(spec.quality)) * F.col("max_level"))).drop("max_level")
        return planes if spec.box is None else planes.where(spec.box.overlap(*map(F.col, ("lx", "ly", "lz", "ux", "uy", "uz"))))

    def global_bitmaps(self, attr: str) -> list[tuple]:
        """(place, bitmap) of each subfile, its bins turned into bins of the whole table's range."""
        lo, hi = self.ranges()[attr]
        return [(self._place(r), bitmap.remapped(r[f"bits_{attr}"], (r[f"lo_{attr}"], r[f"hi_{attr}"]), (lo, hi))) for r in self._subfiles() if r[f"lo_{attr}"] is not None]

    def query_box(self, box: Box, attrs: dict | None = None, quality: float = 1.0) -> DataFrame:
        return self.query(QuerySpec(box, attrs or {}, quality=quality))

    def query_box_progressive(self, box: Box, attrs: dict | None, prev_quality: float, quality: float) -> DataFrame:
        return self.query(QuerySpec(box, attrs or {}, prev_quality, quality))

    def query_json(self, text: str) -> DataFrame:
        return self.query(QuerySpec.from_json(text))

    def serve(self, text: str) -> DataFrame:
        """The answer to a server's request: positions and one attribute as floats."""
        spec = QuerySpec.from_server_json(text, self.schema)
        return self.query(spec).select(*[F.col(c).cast("float").alias(c) for c in spec.columns])

    def serve_binary(self, text: str) -> DataFrame:
        """The answer as a server sends it, in parts (n, answer) of ANSWER_ROWS rows at most, each whole by itself.

        A part is its number of rows (u32), their positions (3 f32 each), then the
        attribute's values (f32); see ``joined_answer``.
        """
        rows = self.serve(text)
        kind = pa.schema([("n", pa.int64()), ("answer", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, ANSWER_ROWS):
                    part = batch.slice(start, ANSWER_ROWS)
                    x, y, z, *rest = (c.to_numpy(zero_copy_only=False).astype("<f4") for c in part.columns)
                    values = rest[0].tobytes() if rest else b""
                    raw = struct.pack("<I", part.num_rows) + np.stack([x, y, z], axis=1).tobytes() + values
                    yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64()), pa.array([raw], pa.binary())], schema=kind)

        return rows.mapInArrow(run, "n long, answer binary")

    def read(self, box: Box) -> DataFrame:
        """All rows and attributes of a box, as a restart reads them."""
        return self.query(QuerySpec(box))

    def row_callback(self, spec: QuerySpec, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What a caller does with the rows: a function of the DataFrame, not of each row."""
        return fn(self.query(spec))

    def query_stats(self, spec: QuerySpec) -> dict[str, int]:
        """Subfiles and cells kept and dropped, and rows tested and returned."""
        kept = self._kept(spec)
        only_box = self._kept(replace(spec, attrs={}))
        by_range = self._kept(replace(spec, prune=frozenset({"range"})))
        returned = self.query(spec).count()
        all_ = self._subfiles()
        return {
            "subfiles": len(all_), "subfiles_kept": len(kept), "box_filtered": len(all_) - len(only_box), "range_filtered": len(only_box) - len(by_range),
            "bitmap_filtered": len(by_range) - len(kept), "rows_tested": sum(r.n for r in kept), "rows_returned": returned,
        }

    def report(self) -> dict:
        """Sizes of the table and of its index (see metadata.overhead)."""
        from pointlake.operators.metadata import overhead

        return overhead(self)


def joined_answer(parts: Iterable[bytes]) -> bytes:
    """Parts of a binary answer as one answer."""
    rows, places, values = 0, [], []
    for raw in parts:
        (n,) = struct.unpack_from("<I", raw)
        rows += n
        places.append(raw[4 : 4 + 12 * n])
        values.append(raw[4 + 12 * n :])
    return struct.pack("<I", rows) + b"".join(places) + b"".join(values)


def _live(schema: ParticleSchema, steps: dict[str, str], info: dict) -> Column:
    """Rows that a commit names: of each version the time steps that no later one has replaced."""
    tests = []
    for version, about in info.items():
        gone = [t for t in about["steps"] if steps.get(t or "") != version]
        test = F.col("version") == version
        if gone and schema.timestep:
            test &= ~F.col(schema.timestep).cast("string").isin(gone)
        tests.append(test)
    return reduce(lambda a, b: a | b, tests)


def _box(r) -> Box:
    if r.lx is None or r.ly is None or r.lz is None:
        return Box()
    return Box((r.lx, r.ly, r.lz), (r.ux, r.uy, r.uz))


class ParticleSession:
    """Progressive reading: each refinement returns only rows not returned before."""

    def __init__(self, table: ParticleTable):
        self.table = table
        self.last: QuerySpec | None = None

    def refine(self, spec: QuerySpec) -> DataFrame:
        """A changed filter or a lower quality starts again; a higher one adds to what there is."""
        go_on = self.last is not None and spec.same_filter(self.last) and spec.quality >= self.last.quality
        spec = replace(spec, prev_quality=self.last.quality if go_on else 0.0)
        self.last = spec
        return self.table.query(spec)
