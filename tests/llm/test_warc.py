import gzip
import hashlib
import os
from collections import defaultdict

import duckdb
import pytest

from pointlake.llm import warc

SF = "/root/testdata/sf0.01"


def brute(rows):
    """(id, text) -> sorted (id, bytes, digest, type, refers)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode()].append(i)
    out = []
    for payload, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        given = False
        for i in ids:
            first = len(payload) < 1000 or i == top and not given
            given |= i == top
            out.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "response" if first else "revisit", None if first else top))
    return sorted(out, key=str)


def read(spark, folder):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_back(spark, folder).collect()), key=str)


def test_odd_pages(spark, tmp_path):
    big = "é" * 700
    rows = [(1, big), (2, big), (2, big), (None, big), (3, None), (4, ""), (5, "s" * 999), (6, "s" * 999), (7, "t" * 1000), (-9, "t" * 1000), (8, "x" * 300_000), (None, "n" * 2000), (None, "n" * 2000)]
    df = spark.createDataFrame([(i, f"http://a/{i} b", t, "z") for i, t in rows], "page_id long, url string, html string, digest string")
    made = warc.written(df, str(tmp_path / "a"), roll=3000, shard_bytes=2000)
    assert read(spark, str(tmp_path / "a")) == brute(rows)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, warc.manifest(spark, str(tmp_path / "a")).collect()))
    texts = sorted(bytes(r.payload) for r in warc.read_back(spark, str(tmp_path / "a"), True).where("record_type = 'response'").collect())
    assert texts == sorted((t or "").encode() for t in [big, None, "", "s" * 999, "s" * 999, "t" * 1000, "x" * 300_000, "n" * 2000])
    empty = warc.written(df.limit(0), str(tmp_path / "b"))
    assert empty.count() == 0 and warc.read_back(spark, str(tmp_path / "b")).count() == 0


ENDS = [(-(1 << 63), "a" * 5000), ((1 << 63) - 1, "a" * 5000), (0, "b" * 3000), (None, "a" * 5000)]


def test_shards_are_of_like_size_wherever_the_ids_lie(spark, tmp_path):
    pages = [(i, f"{i} " * 300) for i in range(4000)]
    for n, more in enumerate(([], [(1 << 40, "far")], ENDS, [(i * i * 977, f"{i} " * 200) for i in range(4000, 5000)])):
        rows = pages + more
        df = spark.createDataFrame([(i, "http://a", t) for i, t in rows], "page_id long, url string, html string").repartition(7)
        total, most = sum(len(t) for _, t in rows), 300_000
        made = warc.written(df, str(tmp_path / str(n)), shard_bytes=most).collect()
        assert read(spark, str(tmp_path / str(n))) == brute(rows)
        assert max(r.records for r in made) < 400 and total / most <= len({r.shard for r in made}) <= 1.4 * total / most + 3


def test_pages_without_an_id_are_spread(spark, tmp_path):
    rows = [(None, f"{i % 50} " * 400) for i in range(600)] + [(1, "0 " * 400)]
    df = spark.createDataFrame([(i, f"http://a/{n}", t) for n, (i, t) in enumerate(rows)], "page_id long, url string, html string")
    made = warc.written(df, str(tmp_path / "a"), shard_bytes=50_000).collect()
    assert read(spark, str(tmp_path / "a")) == brute(rows) and max(r.records for r in made) < 150
    ids = [r.record_id for r in warc.read_back(spark, str(tmp_path / "a")).collect()]
    assert len(set(ids)) == len(ids)


def test_readers_want_a_whole_archive(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"{i} " * 400) for i in range(200)], "page_id long, url string, html string")
    folder = tmp_path / "a"
    folder.mkdir()
    (folder / ".tmp-lost-shard-000000-00000.warc.gz").write_bytes(b"half of a file")
    (folder / "shard-000900-00000.warc.gz").write_bytes(b"of no manifest")
    warc.written(df, str(folder), shard_bytes=40_000)
    assert not list(folder.glob(".tmp*")) and warc.read_back(spark, str(folder)).count() == 200
    warc.written(df.where("page_id < 90"), str(folder), shard_bytes=40_000)
    assert warc.read_back(spark, str(folder)).count() == 90
    one = folder / "shard-000001-00000.warc.gz"
    whole = one.read_bytes()
    one.write_bytes(gzip.compress(warc.record(1, "u", b"x", None, 0)))
    with pytest.raises(Exception, match="differs from its manifest"):
        warc.read_back(spark, str(folder)).count()
    one.write_bytes(whole)
    (folder / "shard-000001.manifest.json").unlink()
    with pytest.raises(Exception, match="shard-000001.manifest.json"):
        warc.read_back(spark, str(folder)).count()
    (folder / warc.ARCHIVE).unlink()
    with pytest.raises(FileNotFoundError):
        warc.read_back(spark, str(folder))


def test_same_bytes_however_partitioned(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    made = []
    for name, df in (("a", pages), ("b", pages.repartition(5, "url"))):
        warc.written(df, str(tmp_path / name), roll=20_000, shard_bytes=100_000).collect()
        made.append({f: open(tmp_path / name / f, "rb").read() for f in sorted(os.listdir(tmp_path / name))})
    assert made[0] == made[1] and len(made[0]) > 4 and not any(f.startswith(".tmp") for f in made[0])
    one = next(f for f in made[0] if f.endswith(".gz"))
    assert gzip.decompress(made[0][one]).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_damage_is_seen(tmp_path):
    raw = gzip.compress(warc.record(1, "u", b"payload", None, 0))
    path = tmp_path / "x.warc.gz"
    path.write_bytes(raw[:-20])
    with pytest.raises(ValueError):
        list(warc.read_records(warc.fs.LocalFileSystem(), str(path)))
    path.write_bytes(gzip.compress(warc.record(1, "u", b"payload", None, 0).replace(b"payload\r\n", b"pAyload\r\n")))
    with pytest.raises(ValueError):
        list(warc.read_records(warc.fs.LocalFileSystem(), str(path)))


def test_query_and_its_sql(spark):
    got = sorted(map(tuple, warc.op7_warc_writer(spark, SF).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert got == sorted(con.execute(warc.SQL_OP7).fetchall(), key=str)
    assert got == brute([(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()])
