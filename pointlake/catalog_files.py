"""Queries that go through files: formats written and read back, streams, writer options, answers of a server."""

from __future__ import annotations

import json
import struct
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.catalog import E_SQL, _layout_box, events, written
from pointlake.operators import metadata
from pointlake.operators.convert import convert
from pointlake.operators.table import ParticleTable, joined_answer
from pointlake.operators.writer import ParticleWriter
from pointlake.plans.query import QuerySpec
from pointlake.registry import query
from pointlake.schema import ParticleSchema
from pointlake.sources import binary, text, tree, tree_writer, xml
from pointlake.storage import file_system, scratch
from pointlake.streaming import ingest as stream


def _put(folder: str, name: str, content: bytes) -> str:
    """A file of ``content`` in a folder that is made if need be."""
    files, root = file_system(folder)
    path = f"{root}/{name}"
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(path, compression=None) as out:
        out.write(content)
    return f"{folder}/{name}"


NATION_SQL = "SELECT CAST(n_nationkey AS FLOAT) AS x, CAST(n_regionkey AS FLOAT) AS y, CAST(length(n_name) AS FLOAT) AS z FROM nation"


def nations(spark: SparkSession, sf: str) -> np.ndarray:
    """The 25 nations as points: key, region, length of the name."""
    rows = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_regionkey", F.length("n_name").alias("n")).orderBy("n_nationkey").collect()
    return np.array([tuple(r) for r in rows], np.float64)


# ---- formats ---------------------------------------------------------------------


@query(f"SELECT CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, value, pid FROM ({E_SQL})")
def raw_dump(spark: SparkSession, sf: str) -> DataFrame:
    """E written as raw dumps, one a partition, and read back."""
    df = events(spark, sf).select("x", "y", "z", "value", F.col("pid").alias("id"))
    folder = scratch(spark, "dump")
    schema = ParticleSchema.of(df, pid="id", attrs=("value",))
    schema = ParticleSchema(attrs=("value", "id"), dtypes={**schema.dtypes, "id": "INT_64"})
    binary.write_bp(df.repartition(3), folder, schema).collect()
    return binary.read_bp(spark, f"{folder}/*.bp").select("x", "y", "z", "value", F.col("id").alias("pid"))


@query(f"""WITH e AS ({E_SQL}), f AS (SELECT event_type, min(pid) AS first FROM e GROUP BY 1), k AS (SELECT event_type, row_number() OVER (ORDER BY first) - 1 AS kind FROM f)
SELECT row_number() OVER (ORDER BY pid) - 1 AS pid, CAST(CAST(x AS FLOAT) AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, CAST(kind AS INTEGER) AS atom_id, event_type AS type FROM e JOIN k USING (event_type)""")
def xyz_text(spark: SparkSession, sf: str) -> DataFrame:
    """E written as XYZ text in parts, joined to one text, and read back."""
    folder = scratch(spark, "xyz")
    text.write_xyz(events(spark, sf).select("pid", *[F.col(c).cast("float").alias(c) for c in "xyz"], F.col("event_type").alias("type")), folder)
    head = spark.read.text(f"{folder}/0-head", wholetext=True).first().value
    lines = text.read_xyz_parts(spark, folder)
    joined = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pid", F.concat_ws(" ", "type", *[F.col(c).cast("string") for c in "xyz"]).alias("t")))), lambda r: r["t"]), "\n").alias("body"))
    joined.select(F.concat(F.lit(head), F.col("body")).alias("value")).coalesce(1).write.text(f"{folder}/one")  # the format is one text
    return text.read_xyz(spark, f"{folder}/one/*.txt")


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pid, CAST(s_suppkey AS FLOAT) AS x, CAST(s_nationkey AS FLOAT) AS y, CAST(s_acctbal AS FLOAT) AS z, CAST(s_acctbal AS FLOAT) AS balance FROM supplier")
def json_document(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as a JSON document of particles, read back."""
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_acctbal").orderBy("s_suppkey").toPandas()
    points = rows.to_numpy(np.float64).ravel().tolist()
    path = _put(scratch(spark, "json"), "a.json", json.dumps({"points": points, "attribs": [{"name": "balance", "data": rows["s_acctbal"].tolist()}]}).encode())
    return text.read_json(spark, path)


@query(f"SELECT CAST(row_number() OVER (ORDER BY x) - 1 AS BIGINT) AS pid, CAST(x + 768 AS FLOAT) AS x, y, CAST(z + 1536 AS FLOAT) AS z, x AS v_x, y AS v_y, z AS v_z FROM ({NATION_SQL})")
def cosmology_brick(spark: SparkSession, sf: str) -> DataFrame:
    """A brick of a simulation, moved to its place."""
    p = nations(spark, sf)
    head = struct.pack("<i3fi3f3if", len(p), 1, 2, 3, 5, 1, 2, 3, 1, 2, 3, 9.0)
    folder = scratch(spark, "cosmo")
    _put(folder, "0.000xv102.dat", head + np.hstack([p, p]).astype("<f4").tobytes())
    return binary.read_cosmo(spark, f"{folder}/*.dat").drop("file")


@query(f"SELECT CAST(x - 12 AS FLOAT) AS x, CAST(y - 2 AS FLOAT) AS y, CAST(z - 8 AS FLOAT) AS z, CAST(y AS INTEGER) AS classification, round(CASE WHEN x / 24 <= 0.04045 THEN x / 24 / 12.92 ELSE power((x / 24 + 0.055) / 1.055, 2.4) END, 3) AS red FROM ({NATION_SQL})")
def lidar_points(spark: SparkSession, sf: str) -> DataFrame:
    """A lidar file: scaled whole numbers, classes, colours in linear light."""
    p = nations(spark, sf)
    head = bytearray(227)
    head[:4] = b"LASF"
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<BHI", head, 104, 2, 26, len(p))
    struct.pack_into("<12d", head, 131, 0.5, 0.5, 0.5, 0, 0, 0, 24, 0, 4, 0, 16, 0)
    body = b"".join(struct.pack("<iiiHBBbBH3H", *(int(2 * v) for v in r), 0, 0, int(r[1]), 0, 0, 0, round(r[0] / 24 * 65535), 0, 0) for r in p)
    path = _put(scratch(spark, "las"), "a.las", bytes(head) + body)
    return binary.read_las(spark, path).select("x", "y", "z", "classification", F.round(F.col("r").cast("double"), 3).alias("red"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY x) - 1 AS BIGINT) AS pid, CAST(CASE WHEN x < 10 THEN 0 ELSE 1 END AS INTEGER) AS patch, x, y, z, CAST(x * 10 AS DOUBLE) AS mass FROM ({NATION_SQL})")
def simulation_archive(spark: SparkSession, sf: str) -> DataFrame:
    """A time step of two patches, big-endian, with one variable beside positions."""
    p, folder, docs = nations(spark, sf), scratch(spark, "uda"), []
    for patch, rows in enumerate((p[:10], p[10:])):
        raw = rows.astype(">f8").tobytes() + (rows[:, 0] * 10).astype(">f8").tobytes()
        _put(folder, f"l0/p{patch}.data", raw)
        at = len(rows) * 24
        var = lambda kind, name, a, b, n=len(rows), patch=patch: f'<Variable type="ParticleVariable&lt;{kind}&gt;"><variable>{name}</variable><filename>p{patch}.data</filename><start>{a}</start><end>{b}</end><patch>{patch}</patch><numParticles>{n}</numParticles></Variable>'
        _put(folder, f"l0/p{patch}.xml", f"<Uintah_Output>{var('Point', 'p.x', 0, at)}{var('double', 'mass', at, at + 8 * len(rows))}</Uintah_Output>".encode())
        docs.append(f"<Datafile href='l0/p{patch}.xml'/>")
    return xml.read_uda(spark, _put(folder, "timestep.xml", f"<Uintah_timestep><Meta><endianness>big_endian</endianness></Meta><Data>{''.join(docs)}</Data></Uintah_timestep>".encode()))


@query(f"SELECT CAST(row_number() OVER (ORDER BY x) - 1 AS BIGINT) AS pid, x, y, z, CAST(x AS INTEGER) AS key FROM ({NATION_SQL})")
def unstructured_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Points and their data of a grid file."""
    p = nations(spark, sf)
    line = lambda values: " ".join(map(str, values))
    doc = f'<VTKFile type="UnstructuredGrid" byte_order="LittleEndian"><UnstructuredGrid><Piece NumberOfPoints="{len(p)}" NumberOfCells="0"><PointData><DataArray type="Int32" Name="key" format="ascii">{line(p[:, 0].astype(int))}</DataArray></PointData><Points><DataArray type="Float32" NumberOfComponents="3" format="ascii">{line(p.ravel())}</DataArray></Points></Piece></UnstructuredGrid></VTKFile>'
    return xml.read_vtu(spark, _put(scratch(spark, "vtu"), "a.vtu", doc.encode())).drop("file")


@query(f"SELECT CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, value, pid, true AS several, true AS leveled FROM ({E_SQL})")
def tree_files(spark: SparkSession, sf: str) -> DataFrame:
    """E written as tree files under an aggregate's header, and read back through it."""
    df = events(spark, sf).select("x", "y", "z", "value", F.col("pid").alias("id"))
    folder = scratch(spark, "trees")
    schema = ParticleSchema.of(df, pid="id", attrs=("value",))
    schema = ParticleSchema(pid="id", attrs=("value", "id"), dtypes={**schema.dtypes, "id": "INT_64"})
    files = tree_writer.write_trees(df, folder, schema, "e", max(1, df.count() // 8) * schema.bytes_per_row())
    back = tree.open_tree(spark, f"{folder}/e.pbat")
    levels = back.agg(F.count_distinct("lod_level")).first()[0]
    return back.select("x", "y", "z", "value", F.col("id").alias("pid"), F.lit(files > 1).alias("several"), F.lit(levels > 1).alias("leveled"))


# ---- writing, streams and answers --------------------------------------------------


OPTIONS = {
    "adaptive": {}, "best axis": {"findBestAxis": True}, "fixed": {"fixedSubfiles": 6}, "blocks": {"blockColumn": "day"},
    "no layout": {"buildLayout": False}, "uneven": {"maxSplitImbalanceRatio": 0.2, "maxOverfullAggregatorFactor": 3.0},
}


@query("SELECT o AS options, (SELECT count(*) FROM events) AS n, (SELECT CAST(sum(event_id) AS BIGINT) FROM events) AS pids, true AS reported, true AS several FROM (VALUES " + ", ".join(f"('{o}')" for o in OPTIONS) + ") AS t(o)")
def writer_options(spark: SparkSession, sf: str) -> DataFrame:
    """E written under each of the writer's options and read back whole."""
    df = events(spark, sf)
    schema, rows, out = ParticleSchema.of(df, attrs=("value",)), df.count(), []
    for name, options in OPTIONS.items():
        writer = ParticleWriter(df, schema).option("bytesPerSubfile", max(1, rows // 8) * schema.bytes_per_row())
        for key, value in options.items():
            writer.option(key, value)
        path = scratch(spark, "options")
        report = writer.save(path)
        read = ParticleTable.open(spark, path).query(QuerySpec(columns=["pid"]))
        out.append(read.agg(F.count(F.lit(1)).alias("n"), F.sum("pid").alias("pids")).select(F.lit(name).alias("options"), "n", "pids", F.lit(report.rows == rows).alias("reported"), F.lit(report.subfiles > 1).alias("several")))
    return reduce(DataFrame.unionByName, out)


@query(f"WITH e AS ({E_SQL}) SELECT day, count(*) AS n, min(value) AS lo, max(value) AS hi, count(*) AS again FROM e GROUP BY day")
def stream_of_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Days that arrive as a stream become time steps; one that comes again replaces itself."""
    df, folder = events(spark, sf), scratch(spark, "stream")
    df.repartition("day").write.parquet(f"{folder}/in")
    schema = ParticleSchema.of(df, attrs=("value",), timestep="day")
    source = stream.snapshots(spark, f"{folder}/in", df.schema, files_per_batch=1000)
    for check in ("a", "b"):  # a second stream from the start brings every day again
        stream.ingest(source, schema, f"{folder}/out", f"{folder}/{check}").awaitTermination()
    table = ParticleTable.open(spark, f"{folder}/out")
    kept = table.subfiles_df.groupBy("day").agg(F.sum("n").alias("n"), F.min("min_value").alias("lo"), F.max("max_value").alias("hi"))
    return kept.join(table.query(QuerySpec(columns=["day"])).groupBy("day").agg(F.count(F.lit(1)).alias("again")), "day")


@query(f"WITH e AS ({E_SQL}), r AS (SELECT min(value) AS lo, max(value) AS hi FROM e) SELECT CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, CAST(value AS FLOAT) AS value FROM e, r WHERE value BETWEEN 20 AND 60")
def binary_answer(spark: SparkSession, sf: str) -> DataFrame:
    """A server's answer in bytes, in parts, taken apart again where the parts are."""
    parts = written(spark, sf, "cells").serve_binary('{"quality": 1, "attribute": "value", "range_min": 20, "range_max": 60}')

    def rows(batches):
        import pandas as pd

        for batch in batches:
            for raw in batch["answer"]:
                (n,) = struct.unpack_from("<I", joined_answer([bytes(raw)]))
                p, v = np.frombuffer(raw, "<f4", 3 * n, 4).reshape(n, 3), np.frombuffer(raw, "<f4", n, 4 + 12 * n)
                yield pd.DataFrame({"x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "value": v})

    return parts.mapInPandas(rows, "x float, y float, z float, value float")


@query(f"WITH e AS ({E_SQL}) SELECT 'cells' AS name, count(*) AS num_points, min(value) AS lo, max(value) AS hi FROM e UNION ALL SELECT 'steps', count(*), min(value), max(value) FROM e")
def table_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Written tables as a server lists them."""
    listed = metadata.listing(spark, {name: written(spark, sf, name) for name in ("cells", "steps")})
    return listed.select("name", "num_points", F.col("attributes")[0]["lo"].alias("lo"), F.col("attributes")[0]["hi"].alias("hi"))


@query("SELECT true AS touching, true AS fewer, true AS shallow, true AS none FROM region WHERE r_regionkey = 0")
def planes_of_a_query(spark: SparkSession, sf: str) -> DataFrame:
    """Split planes of a box are those of the whole that touch it; a low quality has no more, a range that holds nothing none."""
    table = written(spark, sf, "cells")
    box, _ = _layout_box(table)
    whole = table.split_planes(QuerySpec())
    touching = whole.where(box.overlap(*map(F.col, ("lx", "ly", "lz", "ux", "uy", "uz")))).count()
    part, low = table.split_planes(QuerySpec(box)).count(), table.split_planes(QuerySpec(quality=0.05)).count()
    hi = table.ranges()["value"][1]
    none = table.split_planes(QuerySpec(attrs={"value": [(hi + 1, hi + 2)]})).count()
    return spark.createDataFrame([(part == touching, part < whole.count(), low <= whole.count(), none == 0)], "touching boolean, fewer boolean, shallow boolean, none boolean")


@query(f"SELECT CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, value, pid AS id, true AS own_pid FROM ({E_SQL})")
def converted(spark: SparkSession, sf: str) -> DataFrame:
    """Raw dumps turned into a written table in one call; rows of all files get ids of their own."""
    df = events(spark, sf).select("x", "y", "z", "value", F.col("pid").alias("id"))
    folder = scratch(spark, "convert")
    schema = ParticleSchema.of(df, pid="id", attrs=("value",))
    binary.write_bp(df.repartition(3), f"{folder}/in", ParticleSchema(attrs=("value", "id"), dtypes={**schema.dtypes, "id": "INT_64"})).collect()
    convert(spark, f"{folder}/in/*.bp", f"{folder}/out", {"bytesPerSubfile": max(1, df.count() // 8) * 28})
    rows = ParticleTable.open(spark, f"{folder}/out").query(QuerySpec())
    ids = rows.agg(F.count_distinct("pid").alias("n"), F.max("pid").alias("top")).first()
    return rows.select("x", "y", "z", "value", "id", F.lit(ids.n == (ids.top + 1 if ids.n else 0)).alias("own_pid"))
