import math
import re

import numpy as np

from pointlake.llm import mixing

SF = "/root/testdata/sf0.01"


def water(sizes, weights=(5, 2, 1)):
    names = sorted((n for n in sizes if n is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, fixed = sum(sizes.values()), {n: 0 for n in names if sizes[n] == 0}
    while True:
        free = [n for n in names if n not in fixed]
        left = total - sum(fixed.values())
        share = {n: left * w[n] / sum(w[k] for k in free) for n in free}
        over = [n for n in free if share[n] > 3 * sizes[n]]
        if not over:
            return {**fixed, **share}
        fixed |= {n: 3 * sizes[n] for n in over}


def check(rows, docs, slack):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = {}, {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = water(sizes)
    source = {i: s for i, _, s in docs}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 and r.taken == 0 or r.taken % r.size == 0)
        taken[s] = taken.get(s, 0) + r.taken
    assert len(rows) == len(docs)
    assert all(abs(taken[s] - want[s]) <= slack * want[s] for s in sizes), [(s, taken[s], want[s]) for s in sizes]


def test_whole_table(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = mixing.op4_entropy_balance(spark, SF).collect()
    check(rows, docs, 0.005)  # 50 documents a source
    again = mixing.op4_entropy_balance(spark, SF).repartition(3).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_odd_rows(spark):
    docs = [(i, "w " * (1 + i % 7), ["a", "b", None, "é", "Z", ""][i % 6]) for i in range(600)]
    docs += [(1000, None, "a"), (1001, "", "none"), (1002, "x y z", "tiny"), (1003, "q " * 20_000, "b")]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, source string, SIZE string")
    out = mixing.mixed(df)
    assert [c.lower() for c in out.columns].count("size") == 1
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 4 for s, (t, n) in by.items() if s not in ("b", "tiny")) and by["tiny"] == [9.0, 9] and by["none"] == [0.0, 0]
    assert mixing.mixed(df.limit(0)).count() == 0


def test_repeated_rows_share_copies(spark):
    df = spark.createDataFrame([(1, "a b", "s")] * 90 + [(2, "c " * 9, "t")] * 100, "doc_id long, text string, source string")
    rows = mixing.mixed(df).collect()
    assert len(rows) == 190
    for s in "st":
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= own[0].size


def test_rates_are_an_exponential_tilt(spark):
    rng = np.random.default_rng(2)
    cells = [("s", False, int(n), int(d)) for n, d in zip(range(1, 40), rng.integers(1, 30, 39))]
    words = sum(n * d for _, _, n, d in cells)
    goals = spark.createDataFrame([("s", False, 1.7 * words)], "source string, null_source boolean, target double")
    got = mixing.duals(spark.createDataFrame(cells, "source string, null_source boolean, size long, docs long"), goals).first()
    at = sum(n * d * min(3, math.exp(got.dual * n / 39)) for _, _, n, d in cells)
    assert math.isclose(at, 1.7 * words, rel_tol=1e-5)
