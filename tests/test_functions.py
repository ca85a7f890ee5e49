import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointlake.functions import bitmap, color, geometry, lod, morton, util
from pointlake.functions.geometry import Box, Frustum
from pointlake.schema import ParticleSchema, spark_type, width

UNIT = Box((0.0, 0.0, 0.0), (1.0, 1.0, 1.0))


def test_morton_golden_and_round_trip(spark):
    golden = [(0, 0, 0, 0), (1, 0, 0, 1), (0, 1, 0, 2), (0, 0, 1, 4), (1, 2, 3, 53), (5, 9, 1, 1095), (511, 512, 1, 287609421), (1023, 1023, 1023, 1073741823)]
    df = spark.createDataFrame(golden, "x long, y long, z long, want long").withColumn("m", morton.interleaved(F.col("x"), F.col("y"), F.col("z")))
    back = morton.decoded(F.col("m"))
    for r in df.select("*", *[c.alias(n) for c, n in zip(back, ("bx", "by", "bz"))]).collect():
        assert r.m == r.want and (r.bx, r.by, r.bz) == (r.x, r.y, r.z)


def test_planar_clouds_quantize_to_zero(spark):
    df = spark.createDataFrame([(0.0, 5.0), (1.0, 5.0)], "a double, b double")
    got = df.select(morton.quantized(F.col("a"), 0, 1).alias("a"), morton.quantized(F.col("b"), 5, 5).alias("b")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (1023, 0)]


def test_coarse_bits():
    assert morton.coarse_bits({0: 100}) == 4
    assert morton.coarse_bits({i: 300 for i in range(4096)}) == 4
    assert morton.coarse_bits({i: 40 for i in range(4096)}) == 3
    assert morton.coarse_bits({i: 1 for i in range(4096)}) == 1


RANGE = st.tuples(st.floats(-50, 50), st.floats(-50, 50)).map(sorted).map(tuple)


@settings(max_examples=400, deadline=None)
@given(query=RANGE, of=RANGE, t=st.floats(0, 1))
def test_masks_lose_no_value(query, of, t):
    value = query[0] + t * (query[1] - query[0])
    lo, hi = of
    if query[0] <= value <= query[1] and lo <= value <= hi:
        bin_ = min(31, math.floor(32 * (value - lo) / (hi - lo))) if hi > lo else 0
        assert bitmap.mask(query, of) >> bin_ & 1


def test_mask_golden():
    unit = (0.0, 1.0)
    assert bitmap.mask((0, 1), unit) == bitmap.mask((-1, 2), unit) == bitmap.FULL
    assert bitmap.mask((0.25, 0.5), unit) == 0x1FF00 and bitmap.mask((2, 3), unit) == 0
    assert bitmap.mask((1, 1), unit) == 0x80000000 and bitmap.mask((0, 0), unit) == 1
    assert bitmap.mask((0.1, 0.11), unit) == 8 and bitmap.mask((-5, 0.02), unit) == 1
    assert bitmap.mask((3, 5), (0, 32)) == 0x38
    assert bitmap.mask_of([], unit) == bitmap.FULL and bitmap.mask_of([(0, 0), (1, 1)], unit) == 0x80000001
    assert bitmap.mask((5, 1), (0, 9)) == 0 and bitmap.mask((3, 4), (3, 3)) == 1


@settings(max_examples=200, deadline=None)
@given(of=RANGE, to=RANGE, t=st.floats(0, 1))
def test_remapped_bits_cover(of, to, t):
    if of[1] - of[0] < 1e-3 or to[1] - to[0] < 1e-3:
        return
    value = of[0] + t * (of[1] - of[0])
    place = lambda v, r: min(31, math.floor(32 * (v - r[0]) / (r[1] - r[0])))
    if to[0] <= value <= to[1]:
        assert bitmap.remapped(1 << place(value, of), of, to) & (0b111 << place(value, to) >> 1)


def test_bits_and_runs(spark):
    df = spark.createDataFrame([(0.0, 0b1101100), (31.9, 0), (32.0, 1), (33.0, 0xFFFFFFFF), (None, 5)], "v double, b long")
    got = df.select(bitmap.bit_of(F.col("v"), 0.0, 32.0).alias("bit"), bitmap.runs(F.col("b")).alias("r"), bitmap.leading_zeros(F.col("b")).alias("z")).collect()
    assert [r.bit for r in got] == [1, 1 << 31, 1 << 31, 0, 0]
    assert [r.r for r in got] == [[2, 2], [], [1], [32], [1, 1]] and [r.z for r in got] == [25, 32, 31, 0, 29]
    assert df.select(bitmap.bit_of(F.lit(4.0), 4.0, 4.0).alias("b")).first().b == 1
    masks = spark.createDataFrame([(3.0, 5.0, 0.0, 32.0), (9.0, 1.0, 0.0, 9.0), (3.0, 4.0, 3.0, 3.0)], "a double, b double, lo double, hi double")
    assert [r.m for r in masks.select(bitmap.mask_column(*map(F.col, ("a", "b", "lo", "hi"))).alias("m")).collect()] == [0x38, 0, 1]


def test_quality_golden():
    for q, want in ((0, 0), (0.01, 0.0374), (0.05, 0.1614), (0.1, 0.2788), (0.25, 0.5119), (0.5, 0.7404), (0.75, 0.8893), (0.9, 0.9590), (1, 1)):
        assert round(lod.remap_quality(q), 4) == want
    at = lambda q: (lambda d: (d[0], round(d[1], 4)))(lod.depth(lod.remap_quality(q), 4))
    assert [at(q) for q in (0, 0.1, 0.5, 1)] == [(0, 0), (1, 0.3938), (3, 0.7018), (5, 0)]


def test_box():
    a, b = Box((0, 0, 0), (2, 1, 3)), Box((2, 1, 3), (4, 4, 4))
    assert a.overlaps(b) and not a.overlaps(Box((2.1, 0, 0), (3, 1, 1))) and a.union(b) == Box((0, 0, 0), (4, 4, 4))
    assert a.contains_point((2, 1, 3)) and not Box((0, 0, 0), (2, 1, 3), True).contains_point((2, 1, 3))
    assert Box().empty and Box().extended((1, 2, 3)) == Box((1, 2, 3), (1, 2, 3)) and a.axes_by_extent() == (2, 0, 1) and UNIT.axes_by_extent() == (0, 1, 2)
    assert a.center == (1, 0.5, 1.5) and a.contains_box(Box((0, 0, 0), (1, 1, 1)))


def test_box_on_rows(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0), (3, 1.1, 0.0, 0.0), (4, nan, 0.0, 0.0), (5, None, 0.0, 0.0)], "i int, x double, y double, z double")
    inside = lambda box: {r.i for r in df.where(box.contains(F.col("x"), F.col("y"), F.col("z"))).collect()}
    assert inside(UNIT) == {1, 2} and inside(Box(UNIT.lower, UNIT.upper, True)) == {1}
    assert inside(Box((0.0, 0.0, 0.0), (math.inf, 1.0, 1.0))) == {1, 2, 3} and inside(Box((2.0, 0.0, 0.0), (1.0, 1.0, 1.0))) == set()
    d = df.where("i = 3").select(geometry.distance_to_box(F.col("x"), F.col("y"), F.col("z"), UNIT).alias("d")).first().d
    assert abs(d - 0.1) < 1e-12


def test_grids():
    three = {1: (1, 1, 1), 2: (2, 1, 1), 3: (3, 1, 1), 4: (2, 2, 1), 6: (2, 3, 1), 7: (7, 1, 1), 8: (2, 2, 2), 12: (2, 2, 3), 24: (6, 2, 2), 64: (4, 4, 4), 100: (10, 2, 5)}
    assert {n: geometry.grid(n) for n in three} == three
    assert {n: geometry.grid(n, 2) for n in (2, 4, 6, 8, 12, 24)} == {2: (2, 1), 4: (2, 2), 6: (2, 3), 8: (4, 2), 12: (6, 2), 24: (4, 6)}


def test_frustum_is_conservative(spark):
    from pointlake.catalog import VIEW

    f, pick = Frustum.of_matrix(VIEW), random.Random(1)
    rows = [(i, *[v for c in ("x", "y", "z") for v in [pick.uniform(-2, 3)]]) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, x double, y double, z double")
    low, high = tuple(F.col(c) - 0.05 for c in "xyz"), tuple(F.col(c) + 0.05 for c in "xyz")
    kept = {r.i for r in df.where(f.may_touch(low, high)).collect()}
    inside = {i for i, *p in rows if all(a * p[0] + b * p[1] + c * p[2] + d >= 0 for a, b, c, d in f.planes)}
    assert inside and inside <= kept and len(kept) < 400


def test_colour(spark):
    df = spark.createDataFrame([(v / 10,) for v in range(11)], "v double")
    back = df.select("v", color.linear_to_srgb(color.srgb_to_linear(F.col("v"))).alias("b"), color.opacity(F.col("v"), ((0.0, 0.0), (0.5, 1.0), (1.0, 0.0))).alias("o"), color.clamped(F.col("v"), 0.2, 0.3).alias("c")).collect()
    assert all(abs(r.v - r.b) < 1e-9 and abs(r.o - (1 - abs(2 * r.v - 1))) < 1e-9 and r.c == min(0.3, max(0.2, r.v)) for r in back)
    assert df.select(color.lidar_class(F.lit(7)).alias("c")).first().c.startswith("low point")


def test_util():
    assert util.format_bytes(999) == "999B" and util.format_bytes(1.5e6) == "1.50MB" and util.format_count(2500) == "2.50K"
    assert util.align_to(4097, 4096) == 8192 and util.align_to(0, 8) == 0
    assert util.basename("a//b\\c.bat") == "c.bat" and util.extension("x/y.tar.gz") == "gz" and util.basepath("a/b/c") == "a/b" and util.extension("none") == ""
    golden = {0: [3837872008, 932996374, 1548399547, 1612522464], 1: [3795398737, 17903413, 3545275701, 194195274], 42: [565663470, 3244226384, 2504567229, 903561869]}
    for seed, want in golden.items():
        g = util.Pcg32(seed)
        assert [g.next() for _ in range(4)] == want
    assert 0 <= util.Pcg32(7).random() < 1


def test_schema(spark):
    assert width("VEC3_FLOAT") == 12 and width("MAT4_DOUBLE") == 128 and width("UINT_64") == 8
    assert spark_type("UINT_8").typeName() == "short" and spark_type("MAT2_I8").typeName() == "array"
    with pytest.raises(ValueError):
        spark_type("VEC3_I64")
    df = spark.createDataFrame([], "pid long, x float, y float, z float, a float, b float, c float, s string, v array<float>")
    s = ParticleSchema.of(df)
    assert s.attrs == ("a", "b", "c") and s.bytes_per_row() == 24 and ParticleSchema.from_json(s.to_json()) == s
    from pointlake.plans.partition import capacity

    assert capacity(8_000_000, s.bytes_per_row()) == 333_334
    with pytest.raises(ValueError):
        ParticleSchema.of(spark.createDataFrame([], "pid long, x int, y float, z float"))
    with pytest.raises(KeyError):
        ParticleSchema.of(df, attrs=("nope",))


def test_levels_do_not_depend_on_the_parts_ranked(spark):
    df = spark.range(3000).selectExpr("id AS pid", "id % 3 AS cell")
    got = [sorted(map(tuple, lod.assigned(df, ["cell"], "pid", digits).collect())) for digits in (0, 1, 2)]
    assert got[0] == got[1] == got[2]
    assert [lod.digits_for(n) for n in (0, 1, 1 << 20, (1 << 20) + 1, 1 << 24, (1 << 24) + 1)] == [0, 0, 0, 1, 1, 2]
