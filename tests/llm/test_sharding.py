import zlib
from collections import Counter, defaultdict

from pointlake.llm import sharding

SF = "/root/testdata/sf0.01"


def check(rows, texts, shards=16):
    """``texts``: one per row, in any order, as (id, text)."""
    assert len(rows) == len(texts)
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(shards)) and max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    got = sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in rows)
    assert got == sorted((i is None, i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)


def test_whole_table_keeps_copies_together(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = sharding.op5_label_propagation(spark, SF).collect()
    check(rows, docs)
    text, groups = dict(docs), defaultdict(set)
    for r in rows:
        groups[text[r.doc_id]].add(r.shard)
    sizes = Counter(text.values())
    apart = sum(len(s) > 1 for t, s in groups.items() if sizes[t] > 1)
    assert apart <= 0.05 * sum(n > 1 for n in sizes.values())


def test_large_groups_are_split_no_more_than_needed(spark):
    docs = [(i, "hot") for i in range(400)] + [(400 + i, f"pair {i // 2}") for i in range(500)] + [(900 + i, f"one {i}") for i in range(100)] + [(None, None), (None, None), (5, ""), (5, "")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, SHARD string")
    out = sharding.sharded(df)
    assert [c.lower() for c in out.columns].count("shard") == 1
    rows = out.collect()
    check(rows, docs)
    pairs, hot = defaultdict(set), set()
    for r in rows:
        if r.doc_id is not None and 400 <= r.doc_id < 900:
            pairs[(r.doc_id - 400) // 2].add(r.shard)
        if r.doc_id is not None and r.doc_id < 400 and r.size == 4:
            hot.add(r.shard)
    # nine rows in ten are linked here, so that shards are full of them; dealt by hash, 15 pairs in 16 would be apart
    assert sum(len(s) > 1 for s in pairs.values()) <= 75 and len(hot) >= 7


def test_small_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    check(sharding.sharded(df).collect(), [(1, "a"), (2, "a"), (3, None)])
    assert sharding.sharded(df.limit(0)).count() == 0
    same = spark.createDataFrame([(7, "s")] * 1000, "doc_id long, text string")
    check(sharding.sharded(same).collect(), [(7, "s")] * 1000)


def test_rounds_reduce_cut_links(spark):
    cells = spark.createDataFrame([(g, s, 1 + (g * 7 + s) % 3) for g in range(50) for s in range(4)], "g long, shard int, n long")
    total = cells.groupBy().sum("n").first()[0]
    quotas = spark.createDataFrame([(s, total // 4 + 60) for s in range(4)], "shard int, quota long")
    after = sharding.propagated(cells, quotas, 6)
    assert sharding.cut_links(after) < 0.5 * sharding.cut_links(cells)
    assert {r.shard: r.n for r in after.groupBy("shard").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}.items() and after.groupBy().sum("n").first()[0] == total
    assert all(r[1] <= total // 4 + 60 for r in after.groupBy("shard").sum("n").collect())


def test_rounds_go_on_until_nothing_is_gained(spark, caplog):
    cells = spark.createDataFrame([(g, s, 1 + (g * 7 + s) % 3) for g in range(50) for s in range(4)], "g long, shard int, n long")
    total = cells.groupBy().sum("n").first()[0]
    quotas = spark.createDataFrame([(s, total // 4 + 2) for s in range(4)], "shard int, quota long")
    after = sharding.propagated(cells, quotas)
    assert not caplog.records
    assert sharding.cut_links(sharding.propagated(after, quotas, 1)) == sharding.cut_links(after)
    sharding.propagated(cells, quotas, 1)
    assert "after 1 rounds" in caplog.text
