"""The queries of the particle engine and the SQL that gives the same rows.

Views over the test tables: L (lineitem), E (events) and V (embeddings) as particles.
Each query is written with the engine's own functions; its SQL is plain and independent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointlake.functions import bitmap, color, geometry, lod, morton
from pointlake.functions.geometry import Box, Frustum
from pointlake.operators import generators, layout, metadata
from pointlake.operators.table import ParticleSession, ParticleTable
from pointlake.operators.writer import ParticleWriter
from pointlake.plans import partition
from pointlake.plans.query import QuerySpec, run
from pointlake.registry import query
from pointlake.schema import ParticleSchema
from pointlake.storage import scratch

# ---- the views -------------------------------------------------------------------

L = ParticleSchema("l_quantity", "l_extendedprice", "l_discount", "l_orderkey", ("l_tax", "l_partkey", "l_suppkey"))
E = ParticleSchema("x", "y", "z", "pid", ("value",), "day")
V = ParticleSchema("x", "y", "z", "pid", ("label",))


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("pid"), (micros / 1e6).alias("x"), F.col("user_id").cast("double").alias("y"), F.col("value").alias("z"),
        "value", "event_type", F.floor(micros / 86_400_000_000).cast("int").alias("day"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("vec_id").alias("pid"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")], "label"
    )


E_SQL = """SELECT event_id AS pid, epoch_us(ts) / 1e6 AS x, CAST(user_id AS DOUBLE) AS y, value AS z, value, event_type,
  CAST(floor(epoch_us(ts) / 86400000000.0) AS INTEGER) AS day FROM events"""
V_SQL = "SELECT vec_id AS pid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label FROM embeddings"

_WRITTEN: dict[tuple[str, str, str], str] = {}


def written(spark: SparkSession, sf: str, name: str) -> ParticleTable:
    """E as a written table, once a session: ``cells`` in subfiles of a twentieth, ``days`` with a subfile a day, ``steps`` with a time step a day."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _WRITTEN:
        df = events(spark, sf)
        schema = ParticleSchema.of(df, timestep="day" if name == "steps" else None, attrs=("value",))
        size = 1 if name == "days" else max(1, df.count() // 20) * schema.bytes_per_row()
        writer = ParticleWriter(df, schema).option("bytesPerSubfile", size)
        path = scratch(spark, name)
        (writer.block_column("day") if name == "days" else writer).save(path)
        _WRITTEN[key] = path
    return ParticleTable.open(spark, _WRITTEN[key])


def _part(b: Box, lower: tuple[float, float, float], upper: tuple[float, float, float]) -> Box:
    """A box given by shares of another's sides."""
    at = lambda share: tuple(lo + f * (hi - lo) for lo, hi, f in zip(b.lower, b.upper, share))
    return Box(at(lower), at(upper))


L_BOX = Box((10.0, 20_000.0, 0.02), (30.0, 60_000.0, 0.06))
L_WHERE = "l_quantity BETWEEN 10 AND 30 AND l_extendedprice BETWEEN 20000 AND 60000 AND l_discount BETWEEN 0.02 AND 0.06"
L_PICK = "l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax"
L_COLUMNS = L_PICK.split(", ")


# ---- filters ---------------------------------------------------------------------


@query(f"SELECT {L_PICK} FROM lineitem WHERE {L_WHERE}")
def box_query(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of a closed box."""
    return run(lineitem(spark, sf), QuerySpec(L_BOX, columns=L_COLUMNS), L)


@query(f"SELECT {L_PICK} FROM lineitem WHERE l_tax BETWEEN 0.02 AND 0.05")
def attr_range(spark: SparkSession, sf: str) -> DataFrame:
    return run(lineitem(spark, sf), QuerySpec(attrs={"l_tax": [(0.02, 0.05)]}, columns=L_COLUMNS), L)


@query(f"SELECT {L_PICK} FROM lineitem WHERE {L_WHERE} AND (l_tax BETWEEN 0 AND 0.01 OR l_tax BETWEEN 0.06 AND 0.08)")
def attr_multi_range(spark: SparkSession, sf: str) -> DataFrame:
    return run(lineitem(spark, sf), QuerySpec(L_BOX, {"l_tax": [(0.0, 0.01), (0.06, 0.08)]}, columns=L_COLUMNS), L)


@query(f"SELECT {L_PICK} FROM lineitem WHERE {L_WHERE} AND l_tax BETWEEN 0.01 AND 0.06 AND (l_partkey BETWEEN 1 AND 500 OR l_partkey BETWEEN 1000 AND 2000)")
def attr_multi_column(spark: SparkSession, sf: str) -> DataFrame:
    return run(lineitem(spark, sf), QuerySpec(L_BOX, {"l_tax": [(0.01, 0.06)], "l_partkey": [(1, 500), (1000, 2000)]}, columns=L_COLUMNS), L)


@query(f"SELECT l_partkey, l_tax FROM lineitem WHERE {L_WHERE}")
def projection(spark: SparkSession, sf: str) -> DataFrame:
    return run(lineitem(spark, sf), QuerySpec(L_BOX, columns=["l_partkey", "l_tax"]), L)


@query(f"SELECT l_suppkey, count(*) AS n, max(l_extendedprice) AS max_price, min(l_tax) AS min_tax FROM lineitem WHERE {L_WHERE} GROUP BY l_suppkey")
def row_callback(spark: SparkSession, sf: str) -> DataFrame:
    """What a callback per row would add up, as an aggregate of the result."""
    rows = ParticleTable.from_df(lineitem(spark, sf), L)
    return rows.row_callback(QuerySpec(L_BOX), lambda df: df.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("max_price"), F.min("l_tax").alias("min_tax")))


@query("SELECT CAST(l_quantity AS FLOAT) AS l_quantity, CAST(l_extendedprice AS FLOAT) AS l_extendedprice, CAST(l_discount AS FLOAT) AS l_discount, CAST(l_tax AS FLOAT) AS l_tax FROM lineitem WHERE l_tax BETWEEN 0.03 AND 0.04")
def server_query(spark: SparkSession, sf: str) -> DataFrame:
    """A server's request: position and one attribute, as 32-bit floats."""
    return ParticleTable.from_df(lineitem(spark, sf), L).serve('{"quality": 1.0, "prev_quality": 0, "attribute": "l_tax", "range_min": 0.03, "range_max": 0.04}')


@query(f"SELECT {L_PICK} FROM lineitem WHERE l_quantity BETWEEN 1 AND 5 AND l_extendedprice BETWEEN 0 AND 10000 AND l_discount BETWEEN 0 AND 0.1 AND l_tax BETWEEN 0 AND 0.02")
def json_query(spark: SparkSession, sf: str) -> DataFrame:
    """An inspector's request document."""
    spec = QuerySpec.from_json('{"attributes": [{"name": "l_tax", "range": [[0.0, 0.02]]}], "bounds": [[1, 0, 0], [5, 10000, 0.1]]}')
    return run(lineitem(spark, sf), spec, L).select(*L_COLUMNS)


@query("SELECT vec_id, label FROM embeddings WHERE embedding[5] BETWEEN -0.1 AND 0.1 AND label BETWEEN 1 AND 5")
def array_element_range(spark: SparkSession, sf: str) -> DataFrame:
    """A range on an element of a vector attribute."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    spec = QuerySpec(attrs={"embedding[4]": [(-0.1, 0.1)], "label": [(1, 5)]}, columns=["vec_id", "label"])
    return run(df, spec, ParticleSchema(pid="vec_id", attrs=("label",)))


# ---- metadata --------------------------------------------------------------------


@query("SELECT min(l_quantity) AS lx, min(l_extendedprice) AS ly, min(l_discount) + 0.0 AS lz, max(l_quantity) AS ux, max(l_extendedprice) AS uy, max(l_discount) AS uz FROM lineitem")
def bounds(spark: SparkSession, sf: str) -> DataFrame:
    b = ParticleTable.from_df(lineitem(spark, sf), L).bounds()
    return spark.createDataFrame([(*(v + 0.0 for v in b.lower), *b.upper)], "lx double, ly double, lz double, ux double, uy double, uz double")


@query(f"WITH e AS ({E_SQL}) SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) AS ux, max(y) AS uy, max(z) AS uz, count(DISTINCT day) AS boxes FROM e")
def bounds_union(spark: SparkSession, sf: str) -> DataFrame:
    """The union of the boxes that a written table keeps of its subfiles."""
    table = written(spark, sf, "days")
    boxes: list[Box] = []
    table.iterate_subfiles(lambda r: boxes.append(Box((r.lx, r.ly, r.lz), (r.ux, r.uy, r.uz))))
    b = reduce(Box.union, boxes, Box())
    return spark.createDataFrame([(*b.lower, *b.upper, len(boxes))], "lx double, ly double, lz double, ux double, uy double, uz double, boxes long")


@query("""SELECT 'l_tax' AS attr, CAST(min(l_tax) AS DOUBLE) + 0.0 AS lo, CAST(max(l_tax) AS DOUBLE) AS hi FROM lineitem
UNION ALL SELECT 'l_partkey', CAST(min(l_partkey) AS DOUBLE), CAST(max(l_partkey) AS DOUBLE) FROM lineitem
UNION ALL SELECT 'l_suppkey', CAST(min(l_suppkey) AS DOUBLE), CAST(max(l_suppkey) AS DOUBLE) FROM lineitem""")
def attribute_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Range of each attribute: one aggregate, turned to rows."""
    one = lineitem(spark, sf).agg(*[(f(a).cast("double") + 0.0).alias(f"{n}_{a}") for a in L.attrs for n, f in (("lo", F.min), ("hi", F.max))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(f"lo_{a}").alias("lo"), F.col(f"hi_{a}").alias("hi")) for a in L.attrs])).alias("r")).select("r.*")


@query("""SELECT 'lineitem' AS name, count(*) AS num_points, a AS attribute, t AS type, CASE a WHEN 'l_tax' THEN min(l_tax) + 0.0 WHEN 'l_partkey' THEN min(l_partkey) ELSE min(l_suppkey) END AS lo,
  CASE a WHEN 'l_tax' THEN max(l_tax) WHEN 'l_partkey' THEN max(l_partkey) ELSE max(l_suppkey) END AS hi
FROM lineitem, (VALUES ('l_tax', 'FLOAT_64'), ('l_partkey', 'INT_64'), ('l_suppkey', 'INT_64')) AS v(a, t) GROUP BY a, t""")
def dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A listing of tables as a server gives it, one row an attribute."""
    df = lineitem(spark, sf)
    listed = metadata.listing(spark, {"lineitem": ParticleTable.from_df(df, ParticleSchema.of(df, "l_orderkey", L.positions, attrs=L.attrs))})
    return listed.select("name", "num_points", F.explode("attributes").alias("a")).select("name", "num_points", F.col("a.name").alias("attribute"), "a.type", (F.col("a.lo") + 0.0).alias("lo"), "a.hi")


@query(f"WITH e AS ({E_SQL}) SELECT day, round((max(value) - min(value)) / 32, 6) AS bin_size FROM e GROUP BY day")
def bin_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Width of a bitmap's bin by subfile of a written table."""
    table = written(spark, sf, "days")
    day = table.df.groupBy("subfile").agg(F.min("day").alias("day"))
    return metadata.bin_sizes(table.subfiles_df, "value").join(day, "subfile").select("day", F.round("bin_size", 6).alias("bin_size"))


# ---- the curve and its cells -----------------------------------------------------

BOUNDS_SQL = f"e AS ({E_SQL}), b AS (SELECT min(x) AS lx, max(x) AS ux, min(y) AS ly, max(y) AS uy, min(z) AS lz, max(z) AS uz FROM e)"


def _interleave_sql(bits: int = 10) -> str:
    parts = [f"((({axis} >> {b}) & 1) << {3 * b + k})" for b in range(bits) for k, axis in enumerate(("qx", "qy", "qz"))]
    return " | ".join(parts)


def _grid_sql(p: str) -> str:
    return f"CAST(floor(1023.0 * ({p} - l{p}) / (u{p} - l{p})) AS BIGINT) AS q{p}"


MORTON_SQL = f"{BOUNDS_SQL}, q AS (SELECT e.*, {', '.join(map(_grid_sql, 'xyz'))} FROM e, b), m AS (SELECT *, {_interleave_sql()} AS morton FROM q)"
#: Bits an axis of the coarse grid by the number of its cells.
BITS_SQL = """k AS (SELECT CASE WHEN n <= 256 OR n / d4 >= 256 THEN 4 WHEN n / d3 > 256 THEN 3 WHEN n / d2 > 256 THEN 2 ELSE 1 END AS bits FROM (
  SELECT CAST(count(*) AS DOUBLE) AS n, count(DISTINCT morton >> 18) AS d4, count(DISTINCT morton >> 21) AS d3, count(DISTINCT morton >> 24) AS d2 FROM m))"""
CELL_SQL = f"{MORTON_SQL}, {BITS_SQL}, c AS (SELECT m.*, morton >> CAST(3 * (10 - bits) AS BIGINT) AS cell FROM m, k)"


def coded(spark: SparkSession, sf: str) -> DataFrame:
    """E with its Morton codes."""
    df = events(spark, sf)
    return df.withColumn("morton", morton.morton3(F.col("x"), F.col("y"), F.col("z"), layout.bounds_of(df, E)))


def celled(spark: SparkSession, sf: str) -> DataFrame:
    """E with codes and coarse cells."""
    df = coded(spark, sf)
    return df.withColumn("cell", morton.cell(F.col("morton"), morton.coarse_bits_of(df)))


@query(f"WITH {MORTON_SQL} SELECT pid, morton FROM m")
def morton_code(spark: SparkSession, sf: str) -> DataFrame:
    return coded(spark, sf).select("pid", "morton")


@query(f"WITH {MORTON_SQL} SELECT pid, qx AS dx, qy AS dy, qz AS dz FROM m")
def morton_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Codes taken apart again."""
    x, y, z = morton.decoded(F.col("morton"))
    return coded(spark, sf).select("pid", x.alias("dx"), y.alias("dy"), z.alias("dz"))


@query(f"WITH {MORTON_SQL} SELECT pid, morton, row_number() OVER (ORDER BY morton, pid) AS place FROM m")
def morton_order(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each row on the curve: ranked within leading cells, shifted by the cells before."""
    df = coded(spark, sf).withColumn("part", morton.cell(F.col("morton"), morton.COARSE_BITS))
    past = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("before"))  # 4,096 rows at most
    inside = Window.partitionBy("part").orderBy("morton", "pid")
    return df.withColumn("r", F.row_number().over(inside)).join(sizes, "part").select("pid", "morton", (F.col("r") + F.col("before")).alias("place"))


@query(f"WITH {CELL_SQL} SELECT cell, count(*) AS n FROM c GROUP BY cell")
def coarse_cells(spark: SparkSession, sf: str) -> DataFrame:
    return celled(spark, sf).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {MORTON_SQL}, h AS (SELECT 1 AS bits, morton >> 27 AS cell, z FROM m UNION ALL SELECT 2, morton >> 24, z FROM m UNION ALL SELECT 3, morton >> 21, z FROM m UNION ALL SELECT 4, morton >> 18, z FROM m)
SELECT bits, cell, count(*) AS n, min(z) AS min_z, max(z) AS max_z FROM h GROUP BY bits, cell""")
def cell_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of every coarse level: the finest from the rows, each coarser one from the one below it."""
    level = coded(spark, sf).groupBy(morton.cell(F.col("morton"), 4).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("min_z"), F.max("z").alias("max_z"))
    out = level.select(F.lit(4).alias("bits"), "*")
    for bits in (3, 2, 1):
        level = level.groupBy(F.shiftright("cell", 3).alias("cell")).agg(F.sum("n").alias("n"), F.min("min_z").alias("min_z"), F.max("max_z").alias("max_z"))
        out = out.unionByName(level.select(F.lit(bits).alias("bits"), "*"))
    return out


@query(f"WITH {CELL_SQL} SELECT cell, count(*) AS n, min(x) AS lx, max(x) AS ux, min(y) AS ly, max(y) AS uy, min(z) AS lz, max(z) AS uz FROM c GROUP BY cell")
def cell_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return celled(spark, sf).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(n + a) for a in "xyz" for n, f in (("l", F.min), ("u", F.max))])


@query(f"WITH {CELL_SQL} SELECT cell, count(*) AS n, CAST(max(level) AS INTEGER) AS max_level FROM (SELECT cell, length(bin(CAST((row_number() OVER (PARTITION BY cell ORDER BY md5(CAST(pid AS VARCHAR))) - 1) // 8 + 1 AS BIGINT))) - 1 AS level FROM c) GROUP BY cell")
def treelet_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and deepest level by cell."""
    return leveled(spark, sf).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("lod_level").alias("max_level"))


@query(f"""WITH {BOUNDS_SQL}, s AS (SELECT day, min(x) AS lx, max(x) AS ux, min(y) AS ly, max(y) AS uy, min(z) AS lz, max(z) AS uz FROM e GROUP BY day)
SELECT s.day FROM s, b WHERE s.lx <= b.lx + 0.5 * (b.ux - b.lx) AND s.ux >= b.lx + 0.25 * (b.ux - b.lx) AND s.ly <= b.ly + 0.5 * (b.uy - b.ly) AND s.uy >= b.ly + 0.25 * (b.uy - b.ly)""")
def subfile_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Subfiles of a written table whose box touches a box."""
    table = written(spark, sf, "days")
    box = _part(table.bounds(), (0.25, 0.25, 0.0), (0.5, 0.5, 1.0))
    return table.df.where(F.col("subfile").isin(table.subfiles(box))).select("day").distinct()


@query(f"""WITH {BOUNDS_SQL} SELECT CAST(least(greatest(floor(2.0 * (x - lx) / (ux - lx)), 0), 1) + 2 * (least(greatest(floor(3.0 * (y - ly) / (uy - ly)), 0), 2)
  + 3 * least(greatest(floor(2.0 * (z - lz) / (uz - lz)), 0), 1)) AS INTEGER) AS brick, count(*) AS n FROM e, b GROUP BY 1""")
def grid_bricks(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by brick of a grid of 2 x 3 x 2; half open, so that each row is in one."""
    df = events(spark, sf)
    at = geometry.brick(F.col("x"), F.col("y"), F.col("z"), layout.bounds_of(df, E), (2, 3, 2))
    return df.groupBy(at.alias("brick")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CELL_SQL}, s AS (SELECT cell, max(x) - min(x) AS dx, (max(y) - min(y)) * 1000 AS dy, (max(z) - min(z)) * 1000 AS dz FROM c GROUP BY cell),
f AS (SELECT *, CASE WHEN dx >= dy AND dx >= dz THEN 0 WHEN dy >= dz THEN 1 ELSE 2 END AS p, CASE WHEN dz <= dx AND dz <= dy THEN 2 WHEN dy <= dx THEN 1 ELSE 0 END AS r FROM s)
SELECT cell, CAST(p AS VARCHAR) || CAST(3 - p - r AS VARCHAR) || CAST(r AS VARCHAR) AS axes FROM f""")
def axis_order(spark: SparkSession, sf: str) -> DataFrame:
    """Axes by extent, longest first."""
    span = lambda c, k: (F.max(c) - F.min(c)) * k
    s = celled(spark, sf).groupBy("cell").agg((F.max("x") - F.min("x")).alias("dx"), span("y", 1000).alias("dy"), span("z", 1000).alias("dz"))
    return s.select("cell", geometry.axis_order(F.col("dx"), F.col("dy"), F.col("dz")).alias("axes"))


# ---- bitmaps ---------------------------------------------------------------------

BIN_SQL = "CASE WHEN hi > lo THEN least(31, CAST(floor(32.0 * (v - lo) / (hi - lo)) AS INTEGER)) ELSE 0 END"
PRICE_SQL = "r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), p AS (SELECT *, l_extendedprice AS v FROM lineitem, r)"


def _priced(spark: SparkSession, sf: str) -> tuple[DataFrame, float, float]:
    df = lineitem(spark, sf)
    lo, hi = layout.attribute_ranges(df, ("l_extendedprice",))["l_extendedprice"]
    return df, lo, hi


@query(f"WITH {PRICE_SQL} SELECT bin, count(*) AS n FROM (SELECT {BIN_SQL} AS bin FROM p) GROUP BY bin")
def bitmap_bin(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by bin."""
    df, lo, hi = _priced(spark, sf)
    return df.groupBy(bitmap.bin_of(F.col("l_extendedprice"), lo, hi).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PRICE_SQL} SELECT l_suppkey, bit_or(CAST(1 AS BIGINT) << CAST({BIN_SQL} AS BIGINT)) AS bits FROM p GROUP BY l_suppkey")
def bitmap_node_or(spark: SparkSession, sf: str) -> DataFrame:
    """Bitmap by group: the union of its rows' bits."""
    df, lo, hi = _priced(spark, sf)
    return df.groupBy("l_suppkey").agg(F.bit_or(bitmap.bit_of(F.col("l_extendedprice"), lo, hi)).alias("bits"))


@query("""WITH r AS (SELECT l_suppkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1),
f AS (SELECT *, least(31, greatest(0, CAST(floor(32.0 * (greatest(20000.0, lo) - lo) / (hi - lo)) AS INTEGER))) AS a, least(31, greatest(0, CAST(floor(32.0 * (least(45000.0, hi) - lo) / (hi - lo)) AS INTEGER))) AS b FROM r)
SELECT l_suppkey, CASE WHEN 45000 < lo OR 20000 > hi THEN CAST(0 AS BIGINT) WHEN NOT hi > lo THEN CAST(1 AS BIGINT) ELSE ((CAST(1 AS BIGINT) << CAST(b - a + 1 AS BIGINT)) - 1) << CAST(a AS BIGINT) END AS mask FROM f""")
def bitmap_query_mask(spark: SparkSession, sf: str) -> DataFrame:
    """The mask of one range against each group's own range."""
    r = lineitem(spark, sf).groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    return r.select("l_suppkey", bitmap.mask_column(F.lit(20_000.0), F.lit(45_000.0), F.col("lo"), F.col("hi")).alias("mask"))


@query("""WITH g AS (SELECT min(l_extendedprice) AS glo, max(l_extendedprice) AS ghi FROM lineitem), s AS (SELECT l_suppkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1),
o AS (SELECT l.l_suppkey, any_value(lo) AS lo, any_value(hi) AS hi, bit_or(CAST(1 AS BIGINT) << CAST(least(31, CAST(floor(32.0 * (l_extendedprice - lo) / (hi - lo)) AS INTEGER)) AS BIGINT)) AS own FROM lineitem l JOIN s USING (l_suppkey) WHERE hi > lo GROUP BY 1),
c AS (SELECT l_suppkey, own, lo + i * ((hi - lo) / 32) AS a, lo + (i + 1) * ((hi - lo) / 32) AS b, glo, ghi FROM o, g, range(32) AS r(i) WHERE own >> i & 1 = 1),
f AS (SELECT *, least(31, greatest(0, CAST(floor(32.0 * (greatest(a, glo) - glo) / (ghi - glo)) AS INTEGER))) AS p, least(31, greatest(0, CAST(floor(32.0 * (least(b, ghi) - glo) / (ghi - glo)) AS INTEGER))) AS q FROM c)
SELECT l_suppkey, any_value(own) AS own, bit_or(((CAST(1 AS BIGINT) << CAST(q - p + 1 AS BIGINT)) - 1) << CAST(p AS BIGINT)) AS of_all FROM f GROUP BY l_suppkey""")
def bitmap_remap(spark: SparkSession, sf: str) -> DataFrame:
    """Bitmaps on a group's own range, turned into bitmaps on the range of all."""
    df, lo, hi = _priced(spark, sf)
    own = df.groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi")).where("hi > lo")
    nodes = df.join(own, "l_suppkey").groupBy("l_suppkey", "lo", "hi").agg(F.bit_or(bitmap.bit_of(F.col("l_extendedprice"), F.col("lo"), F.col("hi"))).alias("own"))
    return nodes.select("l_suppkey", "own", bitmap.remapped_column(F.col("own"), F.col("lo"), F.col("hi"), F.lit(lo), F.lit(hi)).alias("of_all"))


@query(f"""WITH {PRICE_SQL}, d AS (SELECT l_orderkey, bit_or(CAST(1 AS BIGINT) << CAST({BIN_SQL} AS BIGINT)) AS bits FROM p GROUP BY 1), u AS (SELECT bits, count(*) AS uses FROM d GROUP BY bits)
SELECT bits, uses, row_number() OVER (ORDER BY uses DESC, bits) - 1 AS id FROM u""")
def bitmap_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Different bitmaps, how often each is used, and its id in order of use."""
    df, lo, hi = _priced(spark, sf)
    return bitmap.dictionary(df.groupBy("l_orderkey").agg(F.bit_or(bitmap.bit_of(F.col("l_extendedprice"), lo, hi)).alias("bits")), "bits")


@query(f"""WITH {PRICE_SQL}, d AS (SELECT l_suppkey, bit_or(CAST(1 AS BIGINT) << CAST({BIN_SQL} AS BIGINT)) AS bits FROM p GROUP BY 1)
SELECT l_suppkey, array_to_string(list_transform(regexp_extract_all(bin(bits), '1+'), lambda s: CAST(length(s) AS VARCHAR)), ',') AS runs, CAST(bit_count(bits) AS INTEGER) AS ones, CAST(32 - length(bin(bits)) AS INTEGER) AS zeros FROM d""")
def bitmap_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of the runs of set bits, set bits and leading zeros."""
    nodes = bitmap_node_or(spark, sf)
    return nodes.select("l_suppkey", F.array_join(bitmap.runs(F.col("bits")).cast("array<string>"), ",").alias("runs"), F.bit_count("bits").cast("int").alias("ones"), bitmap.leading_zeros(F.col("bits")).cast("int").alias("zeros"))


# ---- levels of detail ------------------------------------------------------------

LEVEL_SQL = f"""{CELL_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY md5(CAST(pid AS VARCHAR))) - 1 AS rn, count(*) OVER (PARTITION BY cell) AS n FROM c),
v AS (SELECT *, CAST(length(bin(CAST(rn // 8 + 1 AS BIGINT))) - 1 AS INTEGER) AS lod_level FROM o),
t AS (SELECT *, rn - (8 * (CAST(1 AS BIGINT) << CAST(lod_level AS BIGINT)) - 8) AS lod_idx, least(8 * (CAST(1 AS BIGINT) << CAST(lod_level AS BIGINT)), n - (8 * (CAST(1 AS BIGINT) << CAST(lod_level AS BIGINT)) - 8)) AS lod_cnt FROM v),
x AS (SELECT *, max(lod_level) OVER () AS deepest FROM t)"""


def leveled(spark: SparkSession, sf: str) -> DataFrame:
    return leveled_with_depth(spark, sf)[0]


def leveled_with_depth(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """E with levels, and its deepest level; both need the counts of cells, which come before any row is ranked."""
    df = coded(spark, sf)
    counts = morton.coarse_counts(df)
    bits = morton.coarse_bits(counts)
    df, most = df.withColumn("cell", morton.cell(F.col("morton"), bits)), morton.fullest(counts, bits)
    return lod.assigned(df, ["cell"], "pid", lod.digits_for(most)), lod.deepest_level(most)


def _delta_sql(q0: float, q1: float) -> str:
    def edge(q: float, name: str) -> str:
        c = f"least(deepest + 1.0, greatest(0.0, least(1.0, greatest(0.0, log10(1 + 9 * {q}))) * (deepest + 1)))"
        return f"CAST(floor({c}) AS INTEGER) AS d{name}, {c} - floor({c}) AS f{name}"

    return f"""(SELECT pid, lod_level FROM (SELECT *, {edge(q0, '0')}, {edge(q1, '1')} FROM x)
WHERE (lod_level > d0 OR lod_level = d0 AND lod_idx >= floor(lod_cnt * f0)) AND (lod_level < d1 OR lod_level = d1 AND lod_idx < floor(lod_cnt * f1)))"""


SERIES = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)


def _delta(df: DataFrame, deepest: int, q0: float, q1: float) -> DataFrame:
    return df.where(lod.interval(q0, q1, deepest, F.col("lod_level"), F.col("lod_idx"), F.col("lod_cnt")))


@query(f"WITH {LEVEL_SQL} SELECT pid, cell, lod_level, lod_idx, lod_cnt FROM x")
def lod_assign(spark: SparkSession, sf: str) -> DataFrame:
    return leveled(spark, sf).select("pid", "cell", "lod_level", "lod_idx", "lod_cnt")


@query(f"WITH {LEVEL_SQL} SELECT pid, lod_level FROM {_delta_sql(0.1, 0.5)}")
def progressive_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Rows new between two qualities."""
    df, deepest = leveled_with_depth(spark, sf)
    return _delta(df, deepest, 0.1, 0.5).select("pid", "lod_level")


@query(f"WITH {LEVEL_SQL} " + " UNION ALL ".join(f"SELECT CAST({b} AS DOUBLE) AS quality, count(*) AS n FROM {_delta_sql(a, b)}" for a, b in zip(SERIES, SERIES[1:])))
def progressive_series(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that each quality of a series adds, counted in one pass."""
    df, deepest = leveled_with_depth(spark, sf)
    args = (F.col("lod_level"), F.col("lod_idx"), F.col("lod_cnt"))
    one = df.agg(*[F.count_if(lod.interval(a, b, deepest, *args)).alias(f"q{i}") for i, (a, b) in enumerate(zip(SERIES, SERIES[1:]))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(b).alias("quality"), F.col(f"q{i}").alias("n")) for i, b in enumerate(SERIES[1:])])).alias("r")).select("r.*")


@query(f"WITH {LEVEL_SQL} SELECT pid FROM x")
def progressive_union(spark: SparkSession, sf: str) -> DataFrame:
    """The series' deltas together, each row once for every delta that has it: rows are ranked once."""
    df, deepest = leveled_with_depth(spark, sf)
    args = (F.col("lod_level"), F.col("lod_idx"), F.col("lod_cnt"))
    holds = F.array(*[F.when(lod.interval(a, b, deepest, *args), F.lit(i)) for i, (a, b) in enumerate(zip(SERIES, SERIES[1:]))])
    return df.select("pid", F.explode(F.array_compact(holds))).select("pid")


QUALITIES = (0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


@query("SELECT CAST(q AS DOUBLE) AS quality, round(least(1.0, greatest(0.0, log10(1 + 9 * CAST(q AS DOUBLE)))), 9) AS used FROM (VALUES " + ", ".join(f"({q})" for q in QUALITIES) + ") AS t(q)")
def quality_curve(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(q, round(lod.remap_quality(q), 9)) for q in QUALITIES], "quality double, used double")


@query(f"""WITH {BOUNDS_SQL}, s AS (SELECT day, count(*) AS n, min(x) AS lx, max(x) AS ux, min(value) AS lo, max(value) AS hi FROM e GROUP BY day), g AS (SELECT lx + 0.2 * (ux - lx) AS a, lx + 0.6 * (ux - lx) AS c, uz - 0.02 * (uz - lz) AS v FROM b)
SELECT (SELECT count(*) FROM s) AS subfiles, count(*) FILTER (hi >= v) AS subfiles_kept, (SELECT count(*) FROM s) - count(*) AS box_filtered, count(*) FILTER (hi < v) AS range_filtered,
  CAST(coalesce(sum(n) FILTER (hi >= v), 0) AS BIGINT) AS rows_tested, (SELECT count(*) FROM e, g WHERE x BETWEEN a AND c AND value >= v) AS rows_returned FROM s, g WHERE s.lx <= c AND s.ux >= a""")
def query_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Subfiles that a written table's metadata keep and drop, and rows tested and returned."""
    table = written(spark, sf, "days")
    b = table.bounds()
    box = _part(b, (0.2, 0.0, 0.0), (0.6, 1.0, 1.0))
    got = table.query_stats(QuerySpec(box, {"value": [(b.upper[2] - 0.02 * (b.upper[2] - b.lower[2]), float("inf"))]}, prune=frozenset({"range"})))
    names = ["subfiles", "subfiles_kept", "box_filtered", "range_filtered", "rows_tested", "rows_returned"]
    return spark.createDataFrame([tuple(got[k] for k in names)], ", ".join(f"{k} long" for k in names))


@query("SELECT count(*) AS num_points, count(*) * 20 AS base_bytes, count(DISTINCT CAST(floor(epoch_us(ts) / 86400000000.0) AS INTEGER)) AS subfiles, true AS adds_up, true AS small FROM events")
def overhead_report(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of a written table's index against those of its rows."""
    r = written(spark, sf, "days").report()
    parts = sum(r[f"{k}_bytes"] for k in ("nodes", "bitmap_ids", "dictionary", "ranges"))
    row = (r["num_points"], r["base_bytes"], r["subfiles"], r["total_bytes"] == r["base_bytes"] + parts, 0 < r["overhead_percent"] < 100)
    return spark.createDataFrame([row], "num_points long, base_bytes long, subfiles long, adds_up boolean, small boolean")


# ---- geometry and colour ---------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(power(greatest(10.0 - l_quantity, 0, l_quantity - 30.0), 2) + power(greatest(20000.0 - l_extendedprice, 0, l_extendedprice - 60000.0), 2)
  + power(greatest(0.02 - l_discount, 0, l_discount - 0.06), 2)), 6) AS distance FROM lineitem""")
def distance_to_box(spark: SparkSession, sf: str) -> DataFrame:
    d = geometry.distance_to_box(*map(F.col, L.positions), L_BOX)
    return lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", F.round(d, 6).alias("distance"))


#: A view down -z from (0.5, 0.5, 3) of the unit cube: 60 degrees, square, near 0.1, far 3; rows.
VIEW = [[1.7320508075688774, 0.0, 0.0, -0.8660254037844387], [0.0, 1.7320508075688774, 0.0, -0.8660254037844387], [0.0, 0.0, -1.0689655172413792, 3.0], [0.0, 0.0, -1.0, 3.0]]


def _frustum_sql() -> str:
    f, tests = Frustum.of_matrix(VIEW), []
    for a, b, c, d in f.planes:
        far = " + ".join(f"({n!r}) * {('u' if n >= 0 else 'l') + k}" for n, k in zip((a, b, c), "xyz"))
        tests.append(f"{far} + ({d!r}) >= 0")
    for i, k in enumerate("xyz"):
        own = [p[i] for p in f.corners]
        tests += [f"l{k} <= {max(own)!r}", f"u{k} >= {min(own)!r}"]
    return " AND ".join(tests)


@query(f"""WITH {CELL_SQL}, s AS (SELECT cell, {', '.join(f'(min({k}) - any_value(l{k})) / (any_value(u{k}) - any_value(l{k})) AS l{k}, (max({k}) - any_value(l{k})) / (any_value(u{k}) - any_value(l{k})) AS u{k}' for k in 'xyz')} FROM c, b GROUP BY cell)
SELECT cell FROM s WHERE {_frustum_sql()}""")
def frustum_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells, scaled to the unit cube, that a view may see."""
    df = celled(spark, sf)
    b = layout.bounds_of(df, E)
    scaled = [((f(k) - F.lit(lo)) / F.lit(hi - lo)).alias(n + k) for k, lo, hi in zip("xyz", b.lower, b.upper) for n, f in (("l", F.min), ("u", F.max))]
    cells = df.groupBy("cell").agg(*scaled)
    return cells.where(Frustum.of_matrix(VIEW).may_touch(tuple(F.col(f"l{k}") for k in "xyz"), tuple(F.col(f"u{k}") for k in "xyz"))).select("cell")


@query(f"WITH v AS ({V_SQL}) SELECT pid, round(sqrt(x * x + y * y + z * z), 6) AS magnitude FROM v")
def magnitude(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("pid", F.round(color.magnitude(F.col("x"), F.col("y"), F.col("z")), 6).alias("magnitude"))


@query(f"WITH v AS ({V_SQL}), m AS (SELECT sqrt(x * x + y * y + z * z) AS m FROM v) SELECT round(min(m), 6) AS lo, round(max(m), 6) AS hi FROM m")
def magnitude_range(spark: SparkSession, sf: str) -> DataFrame:
    m = color.magnitude(F.col("x"), F.col("y"), F.col("z"))
    return vectors(spark, sf).agg(F.round(F.min(m), 6).alias("lo"), F.round(F.max(m), 6).alias("hi"))


@query("WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_id, round((value - lo) / (hi - lo), 6) AS t FROM events, r")
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    df = events(spark, sf)
    lo, hi = layout.attribute_ranges(df, ("value",))["value"]
    return df.select(F.col("pid").alias("event_id"), F.round(color.normalized(F.col("value"), lo, hi), 6).alias("t"))


OPACITY = ((0.0, 0.0), (0.25, 0.01), (0.5, 0.4), (1.0, 1.0))


@query("""WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events), t AS (SELECT event_id, (value - lo) / (hi - lo) AS t FROM events, r),
a AS (SELECT event_id, CASE WHEN t <= 0 THEN 0.0 WHEN t < 0.25 THEN 0.0 + t * 0.04 WHEN t < 0.5 THEN 0.01 + (t - 0.25) * 1.56 WHEN t < 1 THEN 0.4 + (t - 0.5) * 1.2 ELSE 1.0 END AS alpha FROM t)
SELECT event_id, round(alpha, 6) AS alpha FROM a WHERE alpha >= 0.02""")
def opacity_cull(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that a transfer function leaves visible."""
    df = events(spark, sf)
    lo, hi = layout.attribute_ranges(df, ("value",))["value"]
    alpha = color.opacity(color.normalized(F.col("value"), lo, hi), OPACITY)
    return df.select(F.col("pid").alias("event_id"), alpha.alias("a")).where(color.visible(F.col("a"))).select("event_id", F.round("a", 6).alias("alpha"))


@query("""WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events), t AS (SELECT event_id, (value - lo) / (hi - lo) AS t FROM events, r),
l AS (SELECT event_id, CASE WHEN t <= 0.04045 THEN t / 12.92 ELSE power((t + 0.055) / 1.055, 2.4) END AS lin FROM t)
SELECT event_id, round(lin, 6) AS linear, round(CASE WHEN lin <= 0.0031308 THEN 12.92 * lin ELSE 1.055 * power(lin, 1 / 2.4) - 0.055 END, 6) AS back FROM l""")
def srgb_linear(spark: SparkSession, sf: str) -> DataFrame:
    """To linear light and back."""
    df = events(spark, sf)
    lo, hi = layout.attribute_ranges(df, ("value",))["value"]
    lin = color.srgb_to_linear(color.normalized(F.col("value"), lo, hi))
    return df.select(F.col("pid").alias("event_id"), F.round(lin, 6).alias("linear"), F.round(color.linear_to_srgb(lin), 6).alias("back"))


@query("SELECT o_custkey, CAST(sum(n) OVER (ORDER BY o_custkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS inclusive, CAST(sum(n) OVER (ORDER BY o_custkey ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS exclusive FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def prefix_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Running totals over ordered keys: within ranges of the key, shifted by the totals of the ranges before."""
    counts = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.expr("o_custkey div 65536"))
    past = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.groupBy("part").agg(F.sum("n").alias("t")).select("part", F.coalesce(F.sum("t").over(past), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("o_custkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.col("within") + F.col("before")
    out = counts.withColumn("within", F.sum("n").over(inside)).join(before, "part")
    return out.select("o_custkey", total.alias("inclusive"), (total - F.col("n")).alias("exclusive"))


# ---- partitions and time ---------------------------------------------------------


@query("SELECT count(*) AS n, true AS within, true AS enough FROM events")
def subfile_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of all subfiles of an adaptive plan with room for a twentieth of the table each; whether all are within 1.5 times that, and at least 20."""
    df = events(spark, sf).drop("day")
    schema = ParticleSchema.of(df, attrs=("value",))
    room = max(1, df.count() // 20)
    placed, _, _ = layout.planned(df, schema, layout.Options(bytes_per_subfile=room * schema.bytes_per_row()))
    sizes = placed.groupBy("subfile").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("n"), (F.max("n") <= 1.5 * room).alias("within"), (F.count(F.lit(1)) >= 20).alias("enough"))


@query(f"""WITH RECURSIVE e AS ({E_SQL}), d AS (SELECT day, count(*) AS n, row_number() OVER (ORDER BY min(x)) - 1 AS r FROM e GROUP BY day), k AS (SELECT count(*) AS days FROM d),
p(lo, hi) AS (SELECT 0, CAST(days AS BIGINT) FROM k UNION ALL SELECT lo + t.f * ((hi - lo) // 2), CASE t.f WHEN 0 THEN lo + (hi - lo) // 2 ELSE hi END FROM p, k, (VALUES (0), (1)) AS t(f) WHERE hi - lo > ceil(days / 8.0)),
f AS (SELECT lo, hi, row_number() OVER (ORDER BY lo) - 1 AS part FROM p, k WHERE hi - lo <= ceil(days / 8.0))
SELECT CAST(part AS INTEGER) AS part, CAST(sum(n) AS BIGINT) AS n, count(*) AS blocks FROM f JOIN d ON r >= lo AND r < hi GROUP BY part""")
def subfile_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed plan: days as blocks, dealt to eight subfiles by halving."""
    df = events(spark, sf)
    days = df.groupBy("day").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in "xyz"]).collect()  # a row a day
    plan = partition.fixed([partition.Block(r.day, (r.x, r.y, r.z), r.n) for r in days], 8)
    of = spark.createDataFrame(list(plan.subfile_of().items()), "day int, part int")
    return df.join(F.broadcast(of), "day").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("day").alias("blocks"))


@query(f"WITH e AS ({E_SQL}) SELECT day AS timestep, count(*) AS n, min(z) AS min_z, max(z) AS max_z FROM e GROUP BY day")
def timestep_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and extent by time step, as the metadata of a written series has them."""
    return written(spark, sf, "steps").subfiles_df.groupBy(F.col("day").alias("timestep")).agg(F.sum("n").alias("n"), F.min("lz").alias("min_z"), F.max("uz").alias("max_z"))


@query(f"WITH e AS ({E_SQL}), d AS (SELECT min(day) AS d FROM e) SELECT DISTINCT CAST(y AS BIGINT) AS user_id FROM e, d WHERE day = d + 1 EXCEPT SELECT CAST(y AS BIGINT) FROM e, d WHERE day = d")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Users of the second time step of a written series that the first has not."""
    table = written(spark, sf, "steps")
    first = table.subfiles_df.agg(F.min("day").alias("d")).first().d
    users = lambda day: table.query(QuerySpec(timestep=day, columns=["y"])).select(F.col("y").cast("long").alias("user_id"))
    return users(first + 1).distinct().join(users(first), "user_id", "left_anti")


# ---- treelets and generators -----------------------------------------------------


@query(f"WITH {CELL_SQL} SELECT cell, count(*) AS n, true AS whole, true AS inner_full, true AS leaves_fit FROM c GROUP BY cell")
def kd_treelets(spark: SparkSession, sf: str) -> DataFrame:
    """k-d treelets by cell: whether places in nodes are gapless, inner nodes hold their rows and leaves no more than theirs."""
    df = layout.with_cells(events(spark, sf).withColumn("subfile", F.lit(0)), E)
    nodes = layout.built(df.select("subfile", "cell", "pid", "x", "y", "z"), ParticleSchema(pid="pid")).groupBy("cell", "lod_node").agg(
        F.count(F.lit(1)).alias("n"), F.min("lod_cnt").alias("a"), F.max("lod_cnt").alias("b"), F.min("lod_idx").alias("lo"), F.max("lod_idx").alias("hi"), F.count_distinct("lod_idx").alias("d")
    )
    good = (F.col("n") == F.col("a")) & (F.col("n") == F.col("b")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("d") == F.col("n"))
    inner = F.count_if(F.col("n") == lod.NODE_ROWS)
    # an inner node holds NODE_ROWS rows, and there is one fewer of them than of leaves
    return nodes.groupBy("cell").agg(F.sum("n").alias("n"), F.bool_and(good).alias("whole"), (2 * inner + 1 >= F.count(F.lit(1))).alias("inner_full"), F.bool_and(F.col("n") <= layout.LEAF_ROWS + lod.NODE_ROWS).alias("leaves_fit"))


@query(f"WITH {CELL_SQL} SELECT cell, true AS binary, true AS inside FROM c GROUP BY cell")
def split_planes(spark: SparkSession, sf: str) -> DataFrame:
    """Planes against nodes of every cell: a tree of n planes has 2 n + 1 nodes, and each plane divides its box."""
    df = layout.with_cells(events(spark, sf).withColumn("subfile", F.lit(0)), E).select("subfile", "cell", "pid", "x", "y", "z")
    nodes = layout.built(df, ParticleSchema(pid="pid")).groupBy("cell").agg(F.count_distinct("lod_node").alias("nodes"))
    pick = lambda side: F.when(F.col("axis") == 0, F.col(f"{side}x")).when(F.col("axis") == 1, F.col(f"{side}y")).otherwise(F.col(f"{side}z"))
    planes = layout.split_planes(df, E).groupBy("cell").agg(F.count(F.lit(1)).alias("planes"), F.bool_and((F.col("position") > pick("l")) & (F.col("position") < pick("u"))).alias("inside"))
    out = nodes.join(planes, "cell", "left")
    return out.select("cell", (2 * F.coalesce("planes", F.lit(0)) + 1 == F.col("nodes")).alias("binary"), F.coalesce("inside", F.lit(True)).alias("inside"))


UNIT = Box((0.0, 0.0, 0.0), (1.0, 1.0, 1.0))


@query("SELECT kind, CAST(n AS BIGINT) AS n, true AS inside, true AS placed, true AS again FROM (VALUES ('uniform', 20000), ('linear', (SELECT sum(2 * 20000 * i // 10100) FROM range(1, 101) AS r(i))), ('exponential', 20000), ('spheres', 20000), ('cut_box', 20000)) AS t(kind, n)")
def generated(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every generator of positions; whether all are inside, lie as they should and come again with the same seed."""
    n = 20_000
    make = {
        "uniform": lambda: generators.uniform(spark, n, UNIT, 1), "linear": lambda: generators.linear_gradient(spark, n, UNIT, 1), "exponential": lambda: generators.exponential_gradient(spark, n, UNIT, 1),
        "spheres": lambda: generators.spheres(spark, n, 5, UNIT, 1), "cut_box": lambda: generators.cut_box(spark, n, UNIT, (0.5, 0.5, 0.5), 1),
    }
    share = lambda test: F.count_if(test) / F.count(F.lit(1))
    x, y, z = map(F.col, "xyz")
    placed = {
        "uniform": F.abs(share(x < 0.5) - 0.5) < 0.02, "linear": share(x < 0.5) < 0.3, "exponential": F.abs(share(x < 0.5) - (1 - F.exp(F.lit(-2.5)))) < 0.02, "spheres": F.count_distinct("x", "y", "z") == F.count(F.lit(1)),
        "cut_box": F.count_if((x < 0.499) & (y < 0.499) & (z < 0.499)) == 0,
    }
    mark = F.sum(F.xxhash64("x", "y", "z").cast("decimal(38,0)"))
    out = []
    for name, made in make.items():
        sums = made().repartition(3).agg(mark.alias("again"))
        out.append(made().agg(F.count(F.lit(1)).alias("n"), F.bool_and(UNIT.contains(x, y, z)).alias("inside"), placed[name].alias("placed"), mark.alias("m")).crossJoin(F.broadcast(sums)).select(F.lit(name).alias("kind"), "n", "inside", "placed", (F.col("m") == F.col("again")).alias("again")))
    return reduce(DataFrame.unionByName, out)


# ---- the written layout ----------------------------------------------------------

E_PICK = "pid, x, y, z, value, event_type"
E_PART = "g AS (SELECT lx + 0.1 * (ux - lx) AS ax, lx + 0.6 * (ux - lx) AS bx, ly + 0.2 * (uy - ly) AS ay, ly + 0.9 * (uy - ly) AS cy, lz + 0.0 * (uz - lz) AS az, lz + 0.5 * (uz - lz) AS bz, lz + 0.05 * (uz - lz) AS v1, lz + 0.2 * (uz - lz) AS v2, lz + 0.4 * (uz - lz) AS v3 FROM b)"
E_WHERE = "x BETWEEN ax AND bx AND y BETWEEN ay AND cy AND z BETWEEN az AND bz"
E_RANGES = "(value BETWEEN lz AND v1 OR value BETWEEN v2 AND v3)"


def _layout_box(table: ParticleTable) -> tuple[Box, list[tuple[float, float]]]:
    b = table.bounds()
    lo, hi = table.ranges()["value"]
    at = lambda f: lo + f * (hi - lo)
    return _part(b, (0.1, 0.2, 0.0), (0.6, 0.9, 0.5)), [(lo, at(0.05)), (at(0.2), at(0.4))]


@query(f"WITH {BOUNDS_SQL}, {E_PART} SELECT {E_PICK} FROM e, g WHERE {E_WHERE}")
def layout_box(spark: SparkSession, sf: str) -> DataFrame:
    """A box of a written table: subfiles dropped by metadata, rows by the scan."""
    table = written(spark, sf, "cells")
    return table.read(_layout_box(table)[0]).select(*E_PICK.split(", "))


@query(f"WITH {BOUNDS_SQL}, {E_PART} SELECT pid, value FROM e, g, b WHERE {E_WHERE} AND {E_RANGES}")
def layout_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """A box and two ranges of a written table, two columns of it."""
    table = written(spark, sf, "cells")
    box, ranges = _layout_box(table)
    return table.query(QuerySpec(box, {"value": ranges}, columns=["pid", "value"]))


@query(f"WITH {BOUNDS_SQL}, {E_PART}, r AS (SELECT pid FROM e, g, b WHERE {E_WHERE} AND {E_RANGES}) SELECT p AS prune, (SELECT count(*) FROM r) AS n, (SELECT CAST(sum(pid) AS BIGINT) FROM r) AS pids FROM (VALUES ('none'), ('range'), ('bitmap'), ('both')) AS t(p)")
def layout_pruning(spark: SparkSession, sf: str) -> DataFrame:
    """One query with and without each way of dropping subfiles: the same rows."""
    table = written(spark, sf, "cells")
    box, ranges = _layout_box(table)
    kinds = {"none": (), "range": ("range",), "bitmap": ("bitmap",), "both": ("range", "bitmap")}
    parts = [table.query(QuerySpec(box, {"value": ranges}, prune=frozenset(p))).agg(F.count(F.lit(1)).alias("n"), F.sum("pid").alias("pids")).select(F.lit(name).alias("prune"), "*") for name, p in kinds.items()]
    return reduce(DataFrame.unionByName, parts)


@query(f"WITH {BOUNDS_SQL}, {E_PART} SELECT pid, 1::BIGINT AS times FROM e, g WHERE {E_WHERE}")
def layout_progressive(spark: SparkSession, sf: str) -> DataFrame:
    """A session's refinements of a box, over k-d treelets: together the whole box, each row once."""
    table = written(spark, sf, "cells")
    session, box = ParticleSession(table), _layout_box(table)[0]
    parts = [session.refine(QuerySpec(box, quality=q, columns=["pid"])) for q in SERIES[1:]]
    return reduce(DataFrame.unionByName, parts).groupBy("pid").agg(F.count(F.lit(1)).alias("times"))


@query("SELECT CAST(q AS DOUBLE) AS quality, true AS grows, true AS contained FROM (VALUES " + ", ".join(f"({q})" for q in SERIES[1:]) + ") AS t(q)")
def layout_qualities(spark: SparkSession, sf: str) -> DataFrame:
    """Each quality has more rows than the one before and all of its rows."""
    table = written(spark, sf, "cells")
    before, out = 0.0, []
    for q in SERIES[1:]:
        now, was = (table.query(QuerySpec(quality=x, columns=["pid"])).withColumn(name, F.lit(1)) for name, x in (("now", q), ("was", before)))
        r = now.join(was, "pid", "full").agg(F.count("now").alias("now"), F.count("was").alias("was"), F.count_if(F.col("now").isNull()).alias("lost")).first()
        out.append((q, r.now > r.was, r.lost == 0))
        before = q
    return spark.createDataFrame(out, "quality double, grows boolean, contained boolean")


@query(f"WITH e AS ({E_SQL}) SELECT count(*) AS n, min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) AS ux, max(y) AS uy, max(z) AS uz, min(value) AS min_value, max(value) AS max_value FROM e")
def layout_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, box and range of a written table, from the table of its cells alone."""
    ends = [f(c).alias(c) for f, cs in ((F.min, ("lx", "ly", "lz", "min_value")), (F.max, ("ux", "uy", "uz", "max_value"))) for c in cs]
    return written(spark, sf, "cells").nodes().agg(F.sum("n").alias("n"), *ends)


@query(f"WITH e AS ({E_SQL}), r AS (SELECT min(value) AS lo, max(value) AS hi FROM e), p AS (SELECT value AS v, lo, hi FROM e, r) SELECT bit_or(CAST(1 AS BIGINT) << CAST({BIN_SQL} AS BIGINT)) AS bits, true AS tight FROM p")
def layout_bitmaps(spark: SparkSession, sf: str) -> DataFrame:
    """The union of the cells' bitmaps is that of all rows; no cell has a bin outside its own range."""
    table = written(spark, sf, "cells")
    lo, hi = (F.lit(float(v)) for v in table.ranges()["value"])
    mine = bitmap.mask_column(F.col("min_value"), F.col("max_value"), lo, hi)
    return table.nodes().agg(F.bit_or("bits_value").alias("bits"), F.bool_and(F.col("bits_value").bitwiseAND(F.bitwise_not(mine)) == 0).alias("tight"))
