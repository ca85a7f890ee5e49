"""Text formats: XYZ atoms and JSON particles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """pid, x, y, z, atom_id, type: a count, a title, then ``TYPE X Y Z`` a line.

    Lines that begin with # are skipped, rows beyond the count are not read, and
    a type's id is its place in the order of first appearance. A file is one
    ordered text, read as one value; its rows are exploded with their places.
    """
    text = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("lines"))
    count = F.trim(F.get("lines", F.lit(0))).cast("int")
    body = F.filter(F.slice("lines", 3, F.greatest(F.size("lines"), F.lit(1))), lambda s: (F.trim(s) != "") & ~F.startswith(F.ltrim(s), F.lit("#")))
    rows = text.select(F.posexplode(F.slice(body, F.lit(1), F.greatest(count, F.lit(0)))).alias("pid", "line"))
    parts = rows.select(F.col("pid").cast("long").alias("pid"), F.split(F.trim("line"), r"\s+").alias("p"))
    rows = parts.select("pid", *[F.element_at("p", i + 2).cast("float").alias(c) for i, c in enumerate("xyz")], F.element_at("p", 1).alias("type"))
    kinds = rows.groupBy("type").agg(F.min("pid").alias("first"))
    kinds = kinds.select("type", (F.row_number().over(Window.orderBy("first")) - 1).alias("atom_id"))  # one row a type
    return rows.join(kinds, "type").select("pid", "x", "y", "z", "atom_id", "type")


def write_xyz(df: DataFrame, folder: str, kind: str = "type") -> None:
    """Rows by pid as XYZ text in parts: ``folder`` has a part with the count and title, then the rows by ranges of pid.

    Each part is written by a task of its own; joined in order of their names, or
    read by ``read_xyz_parts``, they are one XYZ text.
    """
    line = F.concat_ws(" ", F.col(kind), *[F.col(c).cast("string") for c in "xyz"])
    rows = df.select("pid", line.alias("value")).repartitionByRange("pid").sortWithinPartitions("pid")
    spark = df.sparkSession
    spark.createDataFrame([(f"{df.count()}\nparticles",)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/0-head")
    rows.select("value").write.mode("overwrite").text(f"{folder}/1-rows")


def read_xyz_parts(spark: SparkSession, folder: str) -> DataFrame:
    """What ``write_xyz`` wrote: x, y, z and type, line by line, in parallel; pid is the place in the order of parts."""
    lines = spark.read.text(f"{folder}/1-rows").select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = lines.where((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#")))
    sizes = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    past = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    starts = sizes.select("file", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("before"))
    placed = lines.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("block", "at")) - 1).join(starts, "file")
    parts = placed.select((F.col("before") + F.col("r")).alias("pid"), F.split(F.trim("value"), r"\s+").alias("p"))
    return parts.select("pid", *[F.element_at("p", i + 2).cast("float").alias(c) for i, c in enumerate("xyz")], F.element_at("p", 1).alias("type"))


def read_json(spark: SparkSession, path: str, attr: str | None = None) -> DataFrame:
    """pid, x, y, z and one attribute of ``{"points": [x, y, z, ...], "attribs": [{"name", "data"}]}``; the first unless named."""
    kind = "points array<float>, attribs array<struct<name:string,data:array<float>>>"
    doc = spark.read.schema(kind).json(path, multiLine=True)
    chosen = F.get("attribs", F.lit(0)) if attr is None else F.get(F.filter("attribs", lambda a: a["name"] == attr), F.lit(0))
    name = doc.select(chosen["name"].alias("n")).first()
    if name is None or name.n is None:
        raise KeyError(f"request for attribute {attr} which does not exist")
    doc = doc.select("points", chosen["data"].alias("data"))
    ids = doc.select("points", "data", F.explode(F.filter(F.sequence(F.lit(0), F.floor(F.size("points") / 3).cast("int")), lambda i: i < F.floor(F.size("points") / 3))).alias("i"))
    return ids.select(F.col("i").cast("long").alias("pid"), *[F.get("points", F.col("i") * 3 + k).alias(c) for k, c in enumerate("xyz")], F.get("data", F.col("i")).alias(name.n))
