"""Writing a particle table: plan, one shuffle, treelets, Parquet by subfile, metadata, commit.

    path/data/version=.../[timestep=.../]subfile=.../*.parquet   rows, sorted by level then place on the curve
    path/nodes/version=..., path/subfiles/version=...            one row a cell, one a subfile
    path/commits/00000000                                        which version has which time steps (JSON)

Every save writes a version of its own and reads and changes nothing of other versions;
its cost depends on its own rows. What a table is, is said by the commit of the highest
number, which is put in place whole: a save that dies leaves folders that no commit
names, and readers see the table as it was. A time step is replaced as a whole by the
version that has it last; a table without time steps is replaced by each save. Saves at
the same time commit one after the other, each on top of what it finds.

Value bitmaps are on the version's own ranges, which its subfiles' rows carry.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.operators import layout
from pointlake.schema import ParticleSchema
from pointlake.storage import delete, names, read_text, write_once

#: Names of options as they are given to ``option``.
NAMES = {
    "bytesPerSubfile": "bytes_per_subfile", "findBestAxis": "find_best_axis", "maxSplitImbalanceRatio": "imbalance", "maxOverfullAggregatorFactor": "overfull",
    "buildLayout": "build_layout", "fixedSubfiles": "fixed_subfiles", "blockColumn": "block_column",
}


@dataclass
class WriteReport:
    rows: int = 0
    subfiles: int = 0
    base_bytes: int = 0
    ms: dict[str, float] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"rows": self.rows, "subfiles": self.subfiles, "base_bytes": self.base_bytes, "ms": self.ms, "mb_per_s": self.base_bytes * 1e-6 / max(1e-9, sum(self.ms.values()) / 1e3)})


class ParticleWriter:
    def __init__(self, df: DataFrame, schema: ParticleSchema | None = None):
        self.df, self.schema, self.options = df, schema or ParticleSchema.of(df), layout.Options()

    def positions(self, x: str, y: str, z: str) -> "ParticleWriter":
        self.schema = replace(self.schema, x=x, y=y, z=z)
        return self

    def attributes(self, *names: str) -> "ParticleWriter":
        self.schema = ParticleSchema.of(self.df, self.schema.pid, self.schema.positions, self.schema.timestep, names)
        return self

    def block_column(self, name: str) -> "ParticleWriter":
        return self.option("blockColumn", name)

    def option(self, name: str, value) -> "ParticleWriter":
        if name not in NAMES:
            raise KeyError(f"unknown option {name}")
        self.options = replace(self.options, **{NAMES[name]: value})
        return self

    def save(self, path: str) -> WriteReport:
        report, schema, spark = WriteReport(), self.schema, self.df.sparkSession
        keys = [c for c in (schema.timestep,) if c]
        version = uuid.uuid4().hex

        def timed(name: str, fn):
            start = time.perf_counter()
            out = fn()
            report.ms[name] = (time.perf_counter() - start) * 1e3
            return out

        box, rows, ranges = timed("bounds and ranges", lambda: layout.described(self.df, schema, schema.attrs))
        placed, plan, boxes = timed("plan", lambda: layout.planned(self.df, schema, self.options, box, rows))
        placed = layout.with_cells(placed, schema, boxes)
        # the one shuffle of the rows: treelets are grouped within it, and files written from it
        placed = placed.repartition(max(1, len(plan.leaves)), *keys, "subfile")
        if self.options.build_layout:
            placed = layout.built(placed, schema)
        else:
            placed = placed.select("*", F.lit(0).alias("lod_level"), F.lit(0).alias("lod_node"), F.lit(0).cast("long").alias("lod_idx"), F.lit(1).cast("long").alias("lod_cnt"))
        out = placed.sortWithinPartitions(*keys, "subfile", "lod_level", "morton", schema.pid)
        timed("build and write", lambda: out.write.partitionBy(*keys, "subfile").parquet(f"{path}/data/version={version}"))

        def nodes():
            # the schema is given: an empty table has no file to take it from
            data = spark.read.schema(out.schema).parquet(f"{path}/data/version={version}")
            found = layout.node_table(data, schema, ranges)
            found.write.parquet(f"{path}/nodes/version={version}")
            return found.schema

        node_kind = timed("nodes", nodes)

        def subfiles():
            found = layout.subfile_table(spark.read.schema(node_kind).parquet(f"{path}/nodes/version={version}"), schema, ranges)
            found.write.parquet(f"{path}/subfiles/version={version}")
            made = spark.read.schema(found.schema).parquet(f"{path}/subfiles/version={version}")
            steps = made.groupBy(F.col(keys[0]).cast("string").alias("step") if keys else F.lit(None).cast("string").alias("step")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("s")).collect()
            return found.schema, steps

        file_kind, steps = timed("subfiles", subfiles)
        report.rows, report.subfiles = sum(r.n for r in steps), sum(r.s for r in steps)
        report.base_bytes = report.rows * schema.bytes_per_row()
        kinds = {"data": out.schema.json(), "nodes": node_kind.json(), "subfiles": file_kind.json()}
        info = {
            "schema": json.loads(schema.to_json()), "kinds": kinds, "ranges": {a: [None if v is None else float(v) for v in r] for a, r in ranges.items()},
            "splits": [[s.axis, s.position, *s.lower, *s.upper] for s in plan.splits], "steps": [r.step for r in steps],
        }
        write_once(spark, f"{path}/versions", f"{version}.json", json.dumps(info))
        timed("commit", lambda: commit(spark, path, version, {r.step or "": version for r in steps}, bool(keys)))
        return report


def latest(spark: SparkSession, path: str) -> tuple[int, dict[str, str], list[str]]:
    """Number of the latest commit, its steps and versions, and the versions by age."""
    found = [n for n in names(spark, f"{path}/commits") if n.isdigit()]
    if not found:
        return -1, {}, []
    got = json.loads(read_text(spark, f"{path}/commits/{found[-1]}"))
    return int(found[-1]), got["steps"], got["versions"]


def commit(spark: SparkSession, path: str, version: str, steps: dict[str, str], by_step: bool) -> None:
    """Make ``version`` part of the table: it has ``steps`` from now on (all there is, without time steps)."""
    while True:
        number, old, versions = latest(spark, path)
        now = {**old, **steps} if by_step else steps
        live = [v for v in versions if v in now.values()] + [version]
        if write_once(spark, f"{path}/commits", f"{number + 1:08d}", json.dumps({"steps": now, "versions": live})):
            return


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete versions that older commits name and none of the last ``keep``; readers of those older commits lose them.

    Versions that no commit names, which may be saves under way, are left alone.
    """
    numbers = [n for n in names(spark, f"{path}/commits") if n.isdigit()]
    said = {n: set(json.loads(read_text(spark, f"{path}/commits/{n}"))["versions"]) for n in numbers}
    live = set().union(*(said[n] for n in numbers[-keep:]))
    there = {n.removesuffix(".json") for n in names(spark, f"{path}/versions")}
    gone = sorted((set().union(*said.values()) - live) & there)
    for version in gone:
        for part in ("data", "nodes", "subfiles"):
            delete(spark, f"{path}/{part}/version={version}")
        delete(spark, f"{path}/versions/{version}.json")
    return gone
