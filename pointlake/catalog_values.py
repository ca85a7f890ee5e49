"""Queries of the small functions: masks, levels, grids, names, boxes, toggles, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.catalog import E, E_SQL, L, L_WHERE, V_SQL, events, lineitem, vectors
from pointlake.functions import bitmap, color, geometry, lod, morton, util
from pointlake.functions.geometry import Box
from pointlake.operators import layout
from pointlake.plans.query import QuerySpec, run
from pointlake.registry import query
from pointlake.schema import ParticleSchema, width


def _values(rows: list[tuple], names: str) -> str:
    """Rows as a table in SQL."""
    text = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({names})"


# Golden vectors of the blueprint.
MORTON = [(0, 0, 0, 0), (1, 0, 0, 1), (0, 1, 0, 2), (0, 0, 1, 4), (1, 2, 3, 53), (5, 9, 1, 1095), (511, 512, 1, 287609421), (1023, 1023, 1023, 1073741823)]
GRIDS = [(1, 1, 1, 1), (2, 2, 1, 1), (3, 3, 1, 1), (4, 2, 2, 1), (6, 2, 3, 1), (7, 7, 1, 1), (8, 2, 2, 2), (12, 2, 2, 3), (24, 6, 2, 2), (64, 4, 4, 4), (100, 10, 2, 5)]
PCG = [(0, 3837872008, 932996374, 1548399547, 1612522464), (1, 3795398737, 17903413, 3545275701, 194195274), (42, 565663470, 3244226384, 2504567229, 903561869)]
WIDTHS = [("INT_8", 1), ("UINT_16", 2), ("INT_32", 4), ("UINT_64", 8), ("FLOAT_32", 4), ("FLOAT_64", 8), ("VEC2_FLOAT", 8), ("VEC3_DOUBLE", 24), ("VEC4_U8", 4), ("MAT3_FLOAT", 36), ("MAT4_DOUBLE", 128)]
#: Query ranges and value ranges for masks.
MASKS = [(0.0, 1.0, 0.0, 1.0), (-1.0, 2.0, 0.0, 1.0), (0.25, 0.5, 0.0, 1.0), (2.0, 3.0, 0.0, 1.0), (1.0, 1.0, 0.0, 1.0), (0.0, 0.0, 0.0, 1.0), (0.1, 0.11, 0.0, 1.0), (-5.0, 0.02, 0.0, 1.0), (3.0, 5.0, 0.0, 32.0), (3.0, 4.0, 3.0, 3.0)]
MASK_SQL = """CASE WHEN b < lo OR a > hi THEN 0 WHEN NOT hi > lo THEN 1 ELSE
  ((CAST(1 AS BIGINT) << CAST(least(31, floor(32 * (least(b, hi) - lo) / (hi - lo))) - least(31, greatest(0, floor(32 * (greatest(a, lo) - lo) / (hi - lo)))) + 1 AS BIGINT)) - 1) << CAST(least(31, greatest(0, floor(32 * (greatest(a, lo) - lo) / (hi - lo)))) AS BIGINT) END"""


@query(f"SELECT * FROM {_values(MORTON, 'x, y, z, code')}")
def morton_golden(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.createDataFrame([r[:3] for r in MORTON], "x int, y int, z int")
    x, y, z = (F.col(c).cast("long") for c in "xyz")
    back = morton.decoded(morton.interleaved(x, y, z))
    return df.select(*[b.cast("int").alias(c) for b, c in zip(back, "xyz")], morton.interleaved(x, y, z).cast("int").alias("code"))


@query(f"SELECT a, b, lo, hi, CAST({MASK_SQL} AS BIGINT) AS mask, CAST({MASK_SQL} AS BIGINT) AS by_columns FROM (SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM {_values(MASKS, 'a, b, lo, hi')})")
def range_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Bins that a range can have values in: worked out on the driver and by columns."""
    df = spark.createDataFrame([(*r, bitmap.mask(r[:2], r[2:])) for r in MASKS], "a double, b double, lo double, hi double, mask long")
    return df.withColumn("by_columns", bitmap.mask_column(*map(F.col, ("a", "b", "lo", "hi"))))


@query(f"SELECT hi, bit_or(CAST({MASK_SQL} AS BIGINT)) AS mask, any_value((hi - lo) / 32) AS width FROM (SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, 0.0::DOUBLE AS lo, CAST(hi AS DOUBLE) AS hi FROM {_values(MASKS[:-1], 'a, b, lo, hi')}) GROUP BY hi")
def multi_range_masks(spark: SparkSession, sf: str) -> DataFrame:
    """The union of several ranges' bins on one value range, and the width of a bin."""
    rows = []
    for hi in sorted({r[3] for r in MASKS[:-1]}):
        rows.append((hi, bitmap.mask_of([r[:2] for r in MASKS[:-1] if r[3] == hi], (0.0, hi)), bitmap.bin_width(0.0, hi)))
    return spark.createDataFrame(rows, "hi double, mask long, width double")


QUALITY_PAIRS = [(0.0, 0.1), (0.1, 0.5), (0.5, 1.0), (0.0, 1.0), (0.25, 0.75)]


@query(f"""SELECT q0, q1, CAST(floor(c0) AS INTEGER) AS d0, round(c0 - floor(c0), 6) AS f0, CAST(floor(c1) AS INTEGER) AS d1, round(c1 - floor(c1), 6) AS f1 FROM
(SELECT CAST(a AS DOUBLE) AS q0, CAST(b AS DOUBLE) AS q1, least(5, 5 * log10(1 + 9 * CAST(a AS DOUBLE))) AS c0, least(5, 5 * log10(1 + 9 * CAST(b AS DOUBLE))) AS c1 FROM {_values(QUALITY_PAIRS, 'a, b')})""")
def quality_depths(spark: SparkSession, sf: str) -> DataFrame:
    """Whole levels and the fraction of the next one for pairs of qualities, with five levels."""
    rows = []
    for a, b in QUALITY_PAIRS:
        (d0, f0), (d1, f1) = (lod.depth(lod.remap_quality(q), 4) for q in (a, b))
        rows.append((a, b, d0, round(f0, 6), d1, round(f1, 6)))
    return spark.createDataFrame(rows, "q0 double, q1 double, d0 int, f0 double, d1 int, f1 double")


@query(f"SELECT * FROM {_values(GRIDS, 'n, x, y, z')}")
def rank_grids(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(r[0], *geometry.grid(r[0])) for r in GRIDS], "n int, x int, y int, z int")


@query("SELECT seed, nth, CAST(value AS BIGINT) AS value FROM (VALUES " + ", ".join(f"({s}, {i}, {v})" for s, *vs in PCG for i, v in enumerate(vs)) + ") AS t(seed, nth, value)")
def pcg_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = []
    for seed, *_ in PCG:
        made = util.Pcg32(seed)
        rows += [(seed, i, made.next()) for i in range(4)]
    return spark.createDataFrame(rows, "seed int, nth int, value long")


@query(f"SELECT * FROM {_values(WIDTHS, 'name, bytes')}")
def type_widths(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(n, width(n)) for n, _ in WIDTHS], "name string, bytes int")


PATHS = ["/a/b/run.bat", "run.tar.gz", "a//b\\c.bp", "/x/noext", "file:///d/e.pbat"]


@query("""SELECT p AS path, CASE WHEN contains(b, '.') THEN regexp_extract(b, '[^.]*$') ELSE '' END AS extension, b AS basename, CASE WHEN contains(c, '/') THEN regexp_replace(c, '/[^/]*$', '') ELSE '.' END AS folder
FROM (SELECT p, c, regexp_extract(c, '[^/]*$') AS b FROM (SELECT p, regexp_replace(replace(replace(p, '\\', '/'), ':///', ':@'), '//+', '/', 'g') AS c0, replace(c0, ':@', ':///') AS c FROM (VALUES """ + ", ".join(f"('{p}')" for p in PATHS) + ") AS t(p)))")
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(p, util.extension(p), util.basename(p), util.basepath(p)) for p in PATHS], "path string, extension string, basename string, folder string")


SIZES = [0, 999, 1000, 123456, 5 * 10**9, 7 * 10**15]


@query("""SELECT n, CAST(ceil(n / 4096.0) * 4096 AS BIGINT) AS pages, CASE WHEN n < 1000 THEN n || 'B' WHEN n < 1e6 THEN format('{:.2f}KB', n / 1e3) WHEN n < 1e9 THEN format('{:.2f}MB', n / 1e6) WHEN n < 1e12 THEN format('{:.2f}GB', n / 1e9) ELSE format('{:.2f}TB', n / 1e12) END AS bytes
FROM (SELECT CAST(n AS BIGINT) AS n FROM (VALUES """ + ", ".join(f"({n})" for n in SIZES) + ") AS t(n))")
def sizes_as_text(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(n, util.align_to(n, 4096), util.format_bytes(n)) for n in SIZES], "n long, pages long, bytes string")


@query("""WITH f AS (SELECT l_returnflag AS part, min(l_quantity) AS lx, min(l_extendedprice) AS ly, max(l_quantity) AS ux, max(l_extendedprice) AS uy FROM lineitem GROUP BY 1), w AS (SELECT min(lx) AS lx, max(ux) AS ux, min(ly) AS ly, max(uy) AS uy FROM f)
SELECT part, (f.lx + f.ux) / 2 AS centre_x, f.uy - f.ly AS side_y, least(f.lx, 0.0) AS extended_lx, greatest(f.uy, 200000.0) AS extended_uy, f.lx >= w.lx AND f.ux <= w.ux AND f.ly >= w.ly AND f.uy <= w.uy AS inside FROM f, w""")
def box_values(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of parts: centre, diagonal, extension by a point, and whether the whole's box contains them."""
    df = lineitem(spark, sf)
    whole, rows = layout.bounds_of(df, L), []
    for r in df.groupBy("l_returnflag").agg(*[f(c).alias(n + a) for n, f in (("l", F.min), ("u", F.max)) for a, c in zip("xyz", L.positions)]).collect():  # a row a flag
        b = Box((r.lx, r.ly, r.lz), (r.ux, r.uy, r.uz))
        more = b.extended((0.0, 200_000.0, r.lz))
        rows.append((r.l_returnflag, b.center[0], b.diagonal[1], more.lower[0], more.upper[1], whole.contains_box(b)))
    return spark.createDataFrame(rows, "part string, centre_x double, side_y double, extended_lx double, extended_uy double, inside boolean")


@query("SELECT l_orderkey, l_linenumber, l_partkey, least(0.06, greatest(0.02, l_discount)) AS clamped, CASE l_linenumber " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in color.LIDAR_CLASSES.items()) + " ELSE 'reserved' END AS class FROM lineitem")
def clamp_and_class(spark: SparkSession, sf: str) -> DataFrame:
    return lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", color.clamped(F.col("l_discount"), 0.02, 0.06).alias("clamped"), color.lidar_class(F.col("l_linenumber")).alias("class"))


@query(f"SELECT 'closed' AS box, count(*) AS n FROM lineitem WHERE {L_WHERE} UNION ALL SELECT 'half open', count(*) FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 30 AND l_extendedprice >= 20000 AND l_extendedprice < 60000 AND l_discount >= 0.02 AND l_discount < 0.06")
def half_open_box(spark: SparkSession, sf: str) -> DataFrame:
    df, corners = lineitem(spark, sf), ((10.0, 20_000.0, 0.02), (30.0, 60_000.0, 0.06))
    inside = lambda b: F.count_if(b.contains(*map(F.col, L.positions)))
    one = df.agg(inside(Box(*corners)).alias("a"), inside(Box(*corners, half_open=True)).alias("b"))
    return one.select(F.explode(F.array(F.struct(F.lit("closed").alias("box"), F.col("a").alias("n")), F.struct(F.lit("half open").alias("box"), F.col("b").alias("n")))).alias("r")).select("r.box", "r.n")


@query(f"""SELECT 'no range' AS toggle, (SELECT count(*) FROM lineitem WHERE {L_WHERE}) AS n UNION ALL SELECT 'no range, strict', 0 UNION ALL SELECT 'no box', (SELECT count(*) FROM lineitem WHERE l_tax BETWEEN 0.02 AND 0.03)
UNION ALL SELECT 'inverted range', 0 UNION ALL SELECT 'nothing', (SELECT count(*) FROM lineitem)""")
def filter_toggles(spark: SparkSession, sf: str) -> DataFrame:
    """Filters switched off and on: an empty range list, the strict reading of it, no box, a range that holds nothing."""
    df, box = lineitem(spark, sf), Box((10.0, 20_000.0, 0.02), (30.0, 60_000.0, 0.06))
    specs = {
        "no range": QuerySpec(box, {"l_tax": []}), "no range, strict": QuerySpec(box, {"l_tax": []}, strict_empty=True), "no box": QuerySpec(attrs={"l_tax": [(0.02, 0.03)]}),
        "inverted range": QuerySpec(attrs={"l_tax": [(0.05, 0.01)]}), "nothing": QuerySpec(),
    }
    one = df.agg(*[F.count_if(spec.predicate(L, df)).alias(name) for name, spec in specs.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("toggle"), F.col(f"`{n}`").alias("n")) for n in specs])).alias("r")).select("r.toggle", "r.n")


@query(f"WITH v AS ({V_SQL}) SELECT pid, label FROM v WHERE sqrt(x * x + y * y + z * z) BETWEEN 0.1 AND 0.3")
def magnitude_query(spark: SparkSession, sf: str) -> DataFrame:
    """A range on the magnitude of three columns."""
    return run(vectors(spark, sf), QuerySpec(attrs={"|x,y,z|": [(0.1, 0.3)]}, columns=["pid", "label"]), ParticleSchema(attrs=("label",)))


@query(f"""WITH e AS ({E_SQL}), b AS (SELECT min(x) AS lx, max(x) AS ux, min(y) AS ly, max(y) AS uy, min(z) AS lz, max(z) AS uz FROM e)
SELECT CAST(least(floor(2.0 * (x - lx) / (ux - lx)), 1) + 2 * (least(floor(2.0 * (y - ly) / (uy - ly)), 1) + 2 * least(floor(2.0 * (z - lz) / (uz - lz)), 1)) AS INTEGER) AS brick, count(*) AS n, min(pid) AS first FROM e, b GROUP BY 1""")
def bricks_of_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that each of eight readers gets: the grid that so many ranks make, over the bounds."""
    df = events(spark, sf)
    at = geometry.brick(F.col("x"), F.col("y"), F.col("z"), layout.bounds_of(df, E), geometry.grid(8))
    return df.groupBy(at.alias("brick")).agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("first"))
