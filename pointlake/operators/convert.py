"""From files of any known format to a written table, in one call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.functions.util import extension
from pointlake.operators.writer import ParticleWriter, WriteReport
from pointlake.schema import ParticleSchema
from pointlake.sources import binary, text, tree, xml

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bp": binary.read_bp, "dat": binary.read_cosmo, "las": binary.read_las, "xyz": text.read_xyz, "json": text.read_json,
    "xml": xml.read_uda, "vtu": xml.read_vtu, "bat": tree.open_tree, "pbat": tree.open_tree, "parquet": lambda spark, path: spark.read.parquet(path),
}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """The particles of a file, or of files by a pattern, by the extension."""
    kind = extension(path).lower()
    if kind not in READERS:
        raise ValueError(f"no reader for files named .{kind}")
    return READERS[kind](spark, path)


def convert(spark: SparkSession, source: str, target: str, options: dict | None = None) -> WriteReport:
    """Read ``source`` and write it as a table; ids of several files are made different by the file's place.

    Columns that place a row in its old file or tree are left out.
    """
    df = read_any(spark, source)
    if "file" in df.columns:
        files = [r.file for r in df.select("file").distinct().orderBy("file").collect()]  # a row a file
        if len(files) > 1:
            # ids count from 0 in each file: a file's are moved past those of the files before
            sizes = {r.file: r["count"] for r in df.groupBy("file").count().collect()}
            starts, at = [], 0
            for f in files:
                starts.append((f, at))
                at += sizes[f]
            moved = F.broadcast(spark.createDataFrame(starts, "file string, __before long"))
            df = df.join(moved, "file").withColumn("pid", F.col("pid") + F.col("__before")).drop("__before")
    df = df.drop("file", "treelet", "lod_level")
    writer = ParticleWriter(df, ParticleSchema.of(df))
    for name, value in (options or {}).items():
        writer.option(name, value)
    return writer.save(target)
