import json
import random
import re
import struct
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointlake.catalog import E, events
from pointlake.functions import bitmap
from pointlake.functions.geometry import Box
from pointlake.operators import layout, metadata
from pointlake.operators import table as particle_table
from pointlake.operators.table import ParticleSession, ParticleTable
from pointlake.operators.writer import ParticleWriter, commit, latest, vacuum
from pointlake.plans import partition
from pointlake.plans.query import QuerySpec
from pointlake.schema import ParticleSchema
from pointlake.storage import write_once

SF = "/root/testdata/sf0.01"
SERIES = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("table") / "t")
    df = events(spark, SF).drop("day")
    schema = ParticleSchema.of(df, attrs=("value",))
    report = ParticleWriter(df, schema).option("bytesPerSubfile", 1200 * schema.bytes_per_row()).save(path)
    assert report.rows == 10_000 and report.subfiles > 5 and json.loads(report.to_json())["mb_per_s"] > 0
    return ParticleTable.open(spark, path)


def ids(df):
    return sorted(r.pid for r in df.select("pid").collect())


def test_written_table_is_the_table(spark, table):
    df = events(spark, SF).drop("day")
    assert ids(table.query(QuerySpec())) == ids(df) and table.num_points() == 10_000
    b = layout.bounds_of(df, E)
    assert table.bounds() == b and table.describe_attribute(0)["dtype"] == "FLOAT_64"
    box = Box(b.lower, tuple((lo + hi) / 2 for lo, hi in zip(b.lower, b.upper)))
    assert ids(table.read(box)) == ids(df.where(box.contains(F.col("x"), F.col("y"), F.col("z"))))


def test_pruning_changes_nothing_but_the_plan(table):
    lo, hi = table.ranges()["value"]
    b = table.bounds()
    box = Box(b.lower, (b.lower[0] + 0.3 * b.diagonal[0], b.upper[1], b.upper[2]))
    ranges = {"value": [(lo, lo + (hi - lo) * 0.01), (hi - (hi - lo) * 0.01, hi)]}
    want = ids(table.df.where(QuerySpec(box, ranges).predicate(table.schema, table.df)))
    for prune in (set(), {"range"}, {"bitmap"}, {"range", "bitmap"}):
        assert ids(table.query(QuerySpec(box, ranges, prune=frozenset(prune)))) == want
    df = table.query(QuerySpec(box))
    plan = df.sparkSession.sparkContext._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[[^\n]*subfile#\d+ [<>=]", plan)
    assert "PushedFilters" in plan and "GreaterThanOrEqual(x" in plan
    stats = table.query_stats(QuerySpec(box, ranges))
    assert stats["rows_returned"] == len(want) and stats["subfiles_kept"] < stats["subfiles"] and stats["rows_tested"] >= len(want)


def test_deltas_are_disjoint_and_add_up(table):
    seen = []
    for a, b in zip(SERIES, SERIES[1:]):
        part = ids(table.query(QuerySpec(prev_quality=a, quality=b)))
        assert part
        seen += part
    assert len(seen) == len(set(seen)) == 10_000
    assert ids(table.query(QuerySpec(quality=0.0))) == [] and ids(table.query(QuerySpec(prev_quality=0.5, quality=0.5))) == []
    assert ids(table.query(QuerySpec(quality=0.5))) == sorted(ids(table.query(QuerySpec(quality=0.1))) + ids(table.query(QuerySpec(prev_quality=0.1, quality=0.5))))


def test_session(table):
    s = ParticleSession(table)
    low = ids(s.refine(QuerySpec(quality=0.2)))
    more = ids(s.refine(QuerySpec(quality=1.0)))
    assert len(low) + len(more) == 10_000 and not set(low) & set(more)
    assert ids(s.refine(QuerySpec(quality=0.2))) == low
    lo, hi = table.ranges()["value"]
    changed = s.refine(QuerySpec(attrs={"value": [(lo, (lo + hi) / 2)]}, quality=0.2))
    assert set(ids(changed)) <= set(low)


def test_requests(table):
    with pytest.raises(KeyError):
        table.query(QuerySpec(attrs={"nope": [(0, 1)]}))
    assert table.query(QuerySpec(attrs={"value": []})).count() == 10_000 and table.query(QuerySpec(attrs={"value": []}, strict_empty=True)).count() == 0
    assert table.query(QuerySpec(Box((9, 9, 9), (1, 1, 1)))).count() == 0
    served = table.serve('{"quality": 1, "attribute": "unknown"}')
    assert served.columns == ["x", "y", "z", "value"] and served.count() == 10_000
    assert table.serve("{}").count() == table.query(QuerySpec(quality=0.1)).count()
    assert table.query_json('{"attributes": [{"name": "value", "range": [[1e9, 2e9]]}]}').count() == 0
    assert table.query(QuerySpec(attrs={"|x,y|": [(0, 1e12)]})).count() == 10_000


def test_binary_answers(table, monkeypatch):
    monkeypatch.setattr(particle_table, "ANSWER_ROWS", 700)
    request = '{"quality": 0.6, "attribute": "value", "range_min": 1, "range_max": 90}'
    want = sorted(tuple(r) for r in table.serve(request).collect())
    raw = particle_table.joined_answer(bytes(r.answer) for r in table.serve_binary(request).collect())
    (n,) = struct.unpack_from("<I", raw)
    numbers = np.frombuffer(raw, "<f4", 4 * n, 4)
    assert n == len(want) > 0 and len(raw) == 4 + 16 * n
    assert sorted((*map(float, p), float(v)) for p, v in zip(numbers[: 3 * n].reshape(n, 3), numbers[3 * n :])) == want
    assert particle_table.joined_answer([]) == struct.pack("<I", 0)


def test_reports(spark, table):
    r = table.report()
    assert r["num_points"] == 10_000 and r["base_bytes"] == 200_000 and 0 < r["overhead_percent"] < 50
    assert metadata.listing(spark, {"e": table}).first().num_points == 10_000
    assert metadata.bin_sizes(table.subfiles_df, "value").count() == r["subfiles"]
    assert metadata.treelet_sizes(table.nodes()).agg(F.sum("n")).first()[0] == 10_000
    b = table.bounds()
    assert len(table.subfiles(b)) == r["subfiles"] and table.subfiles(Box((-9, -9, -9), (-8, -8, -8))) == []


def test_timesteps_are_replaced_one_by_one(spark, tmp_path):
    kind = "pid long, x double, y double, z double, a int, t int"
    rows = lambda t, n: spark.createDataFrame([(i, float(i), 1.0, 1.0, i, t) for i in range(n)], kind)
    schema = ParticleSchema.of(rows(0, 1), timestep="t")
    path = str(tmp_path / "s")
    ParticleWriter(rows(0, 10), schema).save(path)
    ParticleWriter(rows(1, 20), schema).save(path)
    ParticleWriter(rows(1, 5), schema).save(path)
    table = ParticleTable.open(spark, path)
    assert table.query(QuerySpec(timestep=0)).count() == 10 and table.query(QuerySpec(timestep=1)).count() == 5 and table.num_points() == 15


EDGE = {
    "one row": [(0, 1.0, 2.0, 3.0, 7)],
    "identical rows": [(i, 1.0, 2.0, 3.0, 7) for i in range(700)],
    "planar": [(i, float(i % 40), float(i // 40), 0.0, i) for i in range(1200)],
    "not a number": [(i, float(i), float("nan") if i % 9 == 0 else 1.0, 2.0, None if i % 5 == 0 else i) for i in range(400)],
    "hot cell": [(i, 0.001 * (i % 100), 0.001 * (i // 100), 0.0, i) for i in range(2000)] + [(5000 + i, 100.0 * i, 50.0, 9.0, -i) for i in range(60)],
}


@pytest.mark.parametrize("name", EDGE)
def test_edge_tables(spark, tmp_path, name):
    df = spark.createDataFrame(EDGE[name], "pid long, x double, y double, z double, a int")
    schema = ParticleSchema.of(df)
    ParticleWriter(df, schema).option("bytesPerSubfile", 300 * schema.bytes_per_row()).save(str(tmp_path / "t"))
    table = ParticleTable.open(spark, str(tmp_path / "t"))
    assert ids(table.query(QuerySpec())) == ids(df)
    parts = [ids(table.query(QuerySpec(prev_quality=a, quality=b))) for a, b in zip(SERIES, SERIES[1:])]
    assert sorted(sum(parts, [])) == ids(df)
    assert ids(table.query(QuerySpec(attrs={"a": [(5, 50)]}))) == ids(df.where("a between 5 and 50"))


HOT = {
    "outlier": lambda n: [(i, (i * 7919 % n) / n, (i * 104729 % n) / n, (i * 1299709 % n) / n) for i in range(n)] + [(n, 1e6, 0.5, 0.5)],
    "nested": lambda n: [(i, 10.0 ** -(i % 9) * (1 + (i * 31 % 97) / 97), 0.0, 10.0 ** -(i % 5)) for i in range(n)],
    "one place": lambda n: [(i, 1.0, 1.0, 1.0) for i in range(n)] + [(n + i, float(i), 2.0, 3.0) for i in range(50)],
    "not a number": lambda n: [(i, float("nan"), float(i % 3), float("nan")) for i in range(n)],
}


@pytest.mark.parametrize("name", HOT)
def test_hot_spots_stay_within_capacity(spark, name):
    rows, room = HOT[name](20_000), 1000
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    schema = ParticleSchema.of(df)
    placed, plan, _ = layout.planned(df, schema, layout.Options(bytes_per_subfile=room * schema.bytes_per_row()))
    sizes = [r["count"] for r in placed.groupBy("subfile").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 1.5 * room and len(sizes) <= 60
    assert sorted(sizes) == sorted(n for leaf in plan.leaves if (n := sum(b.rows for b in leaf)))


def test_a_save_reads_and_changes_nothing_of_others(spark, tmp_path):
    kind = "pid long, x double, y double, z double, a int, t int"
    rows = lambda t, n: spark.createDataFrame([(i, float(i), 1.0, 1.0, i * (t + 1), t) for i in range(n)], kind)
    schema = ParticleSchema.of(rows(0, 1), timestep="t")
    path = str(tmp_path / "s")
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "s").rglob("*") if f.is_file()}
    ParticleWriter(rows(0, 300).union(rows(1, 200)), schema).option("bytesPerSubfile", 50 * schema.bytes_per_row()).save(path)
    before, old = files(), ParticleTable.open(spark, path)
    ParticleWriter(rows(1, 40).union(rows(2, 30)), schema).save(path)
    after = files()
    assert all(after[f] == t for f, t in before.items())
    table = ParticleTable.open(spark, path)
    assert [table.query(QuerySpec(timestep=t)).count() for t in range(4)] == [300, 40, 30, 0] and table.num_points() == 370
    assert [old.query(QuerySpec(timestep=t)).count() for t in range(3)] == [300, 200, 0]  # a reader keeps its snapshot
    assert table.ranges()["a"] == (0, 299) and table.nodes().agg(F.sum("n")).first()[0] == 370
    # a save that dies before its commit leaves the table as it was
    spark.createDataFrame([(9, 1.0, 1.0, 1.0, 9, 7)], kind).write.partitionBy("t").parquet(f"{path}/data/version=dead")
    assert ParticleTable.open(spark, path).query(QuerySpec()).count() == 370
    for a, b in zip(SERIES, SERIES[1:]):
        assert ids(table.query(QuerySpec(prev_quality=a, quality=b, timestep=0))) == ids(table.query(QuerySpec(prev_quality=a, quality=b)).where("t = 0"))
    # bitmaps are on each version's own range; on the whole table's they keep every value
    lo, hi = table.ranges()["a"]
    for (version, step, n), bits in table.global_bitmaps("a"):
        own = table.df.where((F.col("version") == version) & (F.col("t") == int(step)) & (F.col("subfile") == n))
        assert all(bits & bitmap.mask((r.a, r.a), (lo, hi)) for r in own.select("a").collect())


def test_vacuum_leaves_what_the_last_commits_name(spark, tmp_path):
    kind = "pid long, x double, y double, z double, a int, t int"
    rows = lambda t, n: spark.createDataFrame([(i, float(i), 1.0, 1.0, i, t) for i in range(n)], kind)
    schema, path = ParticleSchema.of(rows(0, 1), timestep="t"), str(tmp_path / "v")
    for t, n in ((0, 10), (1, 20), (1, 5), (0, 3)):
        ParticleWriter(rows(t, n), schema).save(path)
    assert len(vacuum(spark, path, keep=2)) == 1  # the first of step 1
    assert len(vacuum(spark, path)) == 1 and vacuum(spark, path) == []
    table = ParticleTable.open(spark, path)
    assert table.num_points() == table.query(QuerySpec()).count() == 8
    assert len(list((tmp_path / "v" / "data").iterdir())) == 2


def test_two_saves_at_once_both_take(spark, tmp_path):
    path = str(tmp_path / "c")
    assert write_once(spark, f"{path}/commits", "00000000", "{}") and not write_once(spark, f"{path}/commits", "00000000", "[]")
    path = str(tmp_path / "d")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda v: commit(spark, path, f"v{v}", {str(v): f"v{v}"}, True), range(4)))
    number, steps, versions = latest(spark, path)
    assert number == 3 and steps == {str(v): f"v{v}" for v in range(4)} and sorted(versions) == [f"v{v}" for v in range(4)]


@pytest.mark.parametrize("most", [0, 1000])
def test_many_subfiles_are_joined(table, monkeypatch, most):
    monkeypatch.setattr(particle_table, "MOST_LISTED", most)
    b = table.bounds()
    box = Box(b.lower, (b.lower[0] + 0.3 * b.diagonal[0], b.upper[1], b.upper[2]))
    assert ids(table.query(QuerySpec(box))) == ids(table.df.where(QuerySpec(box).predicate(table.schema, table.df)))
    low, more = (ids(table.query(QuerySpec(box, prev_quality=p, quality=q))) for p, q in ((0.0, 0.3), (0.3, 1.0)))
    assert sorted(low + more) == ids(table.query(QuerySpec(box))) and low == ids(table.query(QuerySpec(quality=0.3)).where(box.contains(F.col("x"), F.col("y"), F.col("z"))))


def test_split_planes_of_a_query(table):
    whole = table.split_planes(QuerySpec())
    b, (lo, hi) = table.bounds(), table.ranges()["value"]
    box = Box(b.lower, tuple((x + y) / 2 for x, y in zip(b.lower, b.upper)))
    rows = lambda df: {(r.version, r.subfile, r.cell, r.node, r.axis, r.position) for r in df.collect()}
    everything, part = rows(whole), rows(table.split_planes(QuerySpec(box)))
    touching = {(r.version, r.subfile, r.cell, r.node, r.axis, r.position) for r in whole.collect() if Box((r.lx, r.ly, r.lz), (r.ux, r.uy, r.uz)).overlaps(box)}
    assert part == touching and 0 < len(part) < len(everything)
    assert rows(table.split_planes(QuerySpec(quality=0.1))) < everything
    assert rows(table.split_planes(QuerySpec(attrs={"value": [(hi + 1, hi + 2)]}))) == set()
    with pytest.raises(KeyError):
        table.split_planes(QuerySpec(attrs={"nope": [(0, 1)]}))


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "pid long, x double, y double, z double, a int")
    report = ParticleWriter(df).save(str(tmp_path / "t"))
    table = ParticleTable.open(spark, str(tmp_path / "t"))
    assert report.rows == 0 and table.query(QuerySpec()).count() == 0 and table.bounds().empty and table.num_points() == 0


def test_fixed_and_raw_options(spark, tmp_path):
    df = events(spark, SF).drop("day")
    schema = ParticleSchema.of(df, attrs=("value",))
    writer = ParticleWriter(df, schema).option("fixedSubfiles", 4).option("buildLayout", False).option("findBestAxis", True).option("maxSplitImbalanceRatio", 4.0).option("maxOverfullAggregatorFactor", 1.5)
    assert 4 <= writer.save(str(tmp_path / "f")).subfiles <= 8
    with pytest.raises(KeyError):
        writer.option("nope", 1)
    blocks = ParticleWriter(df.withColumn("blk", F.col("pid") % 10), schema).block_column("blk").option("bytesPerSubfile", 2000 * schema.bytes_per_row())
    assert blocks.save(str(tmp_path / "g")).rows == 10_000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(0, 9), st.integers(0, 50)), min_size=1, max_size=60), st.integers(1, 200), st.booleans())
def test_plans_keep_blocks_and_capacity(raw, most, best_axis):
    blocks = [partition.Block(i, (float(x), float(y), float(z)), n) for i, (x, y, z, n) in enumerate(raw)]
    plan = partition.adaptive(blocks, most, best_axis)
    assert sorted(b.id for leaf in plan.leaves for b in leaf) == list(range(len(blocks)))
    for leaf in plan.leaves:
        total = sum(b.rows for b in leaf)
        assert total <= 1.5 * most or sum(b.rows > 0 for b in leaf) == 1
    fixed = partition.fixed(blocks, 4)
    assert sorted(b.id for leaf in fixed.leaves for b in leaf) == list(range(len(blocks)))


def test_treelets_do_not_depend_on_order():
    rng = np.random.default_rng(1)
    points, pids = rng.random((3000, 3)), np.arange(3000)
    a = layout.treelet(points, pids, 5)
    turn = rng.permutation(3000)
    b = layout.treelet(points[turn], pids[turn], 5)
    for x, y in zip(a[:4], b[:4]):
        assert (x[turn] == y).all()
    level, node, idx, cnt, planes = a
    assert len(planes) and max(cnt) <= 136 and sorted(zip(node, idx)) == sorted(set(zip(node, idx)))
    inner = {p[0] for p in planes}
    assert all(c == 8 for n, c in zip(node, cnt) if n in inner)


def test_random_queries_against_plain_filters(table):
    pick, df = random.Random(3), table.df
    b, (lo, hi) = table.bounds(), table.ranges()["value"]
    for _ in range(5):
        ends = [sorted(pick.uniform(l, u) for _ in range(2)) for l, u in zip(b.lower, b.upper)]
        r = sorted(pick.uniform(lo, hi) for _ in range(2))
        spec = QuerySpec(Box(tuple(e[0] for e in ends), tuple(e[1] for e in ends)), {"value": [tuple(r)]})
        plain = df.where((F.col("x").between(*ends[0])) & F.col("y").between(*ends[1]) & F.col("z").between(*ends[2]) & F.col("value").between(*r))
        assert ids(table.query(spec)) == ids(plain)
