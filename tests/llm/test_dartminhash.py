import random
from collections import Counter
from itertools import combinations
from math import comb

import numpy as np

from pointlake.llm import dartminhash as dart

SF = "/root/testdata/sf0.01"


def brute(rows):
    """doc id -> class id by all pairs of (id, text): similarity of the shingles' counts."""
    counts = {i: Counter(dart.shingles(t or "").tolist()) for i, t in rows}
    sets = {i: frozenset((s, k) for s, n in c.items() for k in range(n)) for i, c in counts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        small, large = sorted((len(x), len(y)))
        if x == y or small >= 0.8 * large and len(x & y) >= 0.8 * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {i: find(i) for i in sets}


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(3)
    wa = rng.uniform(0.2, 3, 300)
    wb = wa * rng.uniform(0.5, 1.5, 300)
    truth = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    got = [(dart.signature(e, wa) == dart.signature(e, wb)).mean() for e in (rng.integers(0, 2**63, 300, dtype=np.uint64) for _ in range(30))]
    assert abs(np.mean(got) - truth) < 0.02
    one = dart.signature(np.array([5], np.uint64), np.ones(1))
    assert len(set(one.tolist())) == dart.COORDINATES


def test_prefilter_loses_less_than_banding():
    n, p = dart.COORDINATES, dart.THRESHOLD
    lost = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(dart.agree_least(p)))
    assert lost < 0.01 * (1 - p**dart.ROWS) ** dart.BANDS


def test_shingles():
    assert len(dart.shingles("a b c")) == 1 and len(dart.shingles("")) == 0 and (dart.shingles("a b c") != dart.shingles("c b a")).all()
    assert dart.weighted("x " * 10, "count")[1].tolist() == [6.0]


def test_odd_rows_and_large_groups(spark):
    pick = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    text = lambda n: [pick.choice(words) for _ in range(n)]
    base, rows = text(300), []
    for i in range(120):  # variants of one text that differ among each other more than from it
        v = list(base)
        for _ in range(3):
            v[pick.randrange(300)] = "new%d" % pick.randrange(10**9)
        rows.append((i, " ".join(v)))
    rows.append((120, " ".join(base)))
    chain = text(200)
    for i in range(121, 130):
        rows.append((i, " ".join(chain)))
        chain = chain[8:] + text(8)
    rows += [(i, " ".join(text(60) + base[:40])) for i in range(130, 180)]  # a shared passage only
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "one"), (205, "one two"), (206, "x " * 50_000)]
    got = {r.doc_id: r.class_id for r in dart.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    repeated = spark.createDataFrame([(None, "a b", "p"), (None, "a b", "p"), (1, "a  b", "q"), (2, "c", "r"), (2, "c", "r")], "doc_id long, text string, CLASS_ID string")
    out = sorted((r.class_id, r.class_size) for r in dart.classes(repeated).collect())
    assert out == [(1, 3)] * 3 + [(2, 2)] * 2
    clash = spark.createDataFrame([(1, "a b", "z"), (1, "a b", "y"), (1, "a b", None)], "doc_id long, text string, k string")
    assert {tuple(dart.deduplicated(clash.repartition(n)).collect()[0]) for n in (1, 3)} == {(1, "a b", "y")}
    kept = dart.deduplicated(repeated)
    assert kept.columns == ["doc_id", "text", "CLASS_ID"] and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert dart.classes(repeated.limit(0)).count() == 0 and dart.deduplicated(repeated.limit(0)).count() == 0


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = dart.op10_dart_minhash(spark, SF).collect()
    want = brute(docs)
    assert {r.doc_id: r.class_id for r in rows} == want
    rep = {r.doc_id: r.rep_id for r in rows}
    assert all(want[i] == want[r] and rep[r] == r for i, r in rep.items())


def test_links_join_the_classes_and_are_similar(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: Counter(dart.shingles(r.text or "").tolist()) for r in docs.collect()}
    found, root = dart.links(docs).collect(), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in found:
        x, y = texts[a], texts[b]
        assert a < b and sum((x & y).values()) >= 0.8 * sum((x | y).values())
        root[max(find(a), find(b))] = min(find(a), find(b))
    for r in dart.classes(docs).collect():
        assert find(r.rep_id) == r.class_id


def test_weights_decide(spark):
    """Texts with one set of shingles but other counts, and texts whose repeats make them alike."""
    pick = random.Random(6)
    line = lambda k: " ".join(f"w{k}x{i}" for i in range(12)) + " "
    rows = [(1, line(1) * 3 + line(2)), (2, line(1) * 30 + line(2)), (3, line(3) * 40 + line(4)), (4, line(3) * 39 + line(5)), (5, line(3) * 36 + line(6)), (6, line(7) * 2 + line(8))]
    rows += [(100 + i, line(9) * pick.randrange(20, 60)) for i in range(60)]
    got = {r.doc_id: r.class_id for r in dart.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and got[1] != got[2] and got[3] == got[4]
    rng = np.random.default_rng(1)
    u = rng.integers(0, 2**63, 500, dtype=np.uint64)
    w = rng.integers(1, 9, 500).astype(float)
    assert len(set(dart.occurrences(np.sort(u), w).tolist())) == int(w.sum())


def test_blocks_of_long_and_many_texts(spark, monkeypatch):
    """Blocks so small that bands have many of them, with a cloud that its leader does not settle."""
    monkeypatch.setattr(dart, "BLOCK", 1 << 12)
    monkeypatch.setattr(dart, "LEAST_TEXT", 1 << 8)
    pick = random.Random(7)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(90):  # three clouds around texts that are not there, and bridges of some
        v = list(base)
        for j in range(0, 400, 40):
            if pick.random() < 0.55:
                v[j + i % 3] = f"own{i}x{j}"
        rows.append((i, " ".join(v)))
    rows += [(200 + i, " ".join(base + [f"t{i}x{j}" for j in range(3000)])) for i in range(4)]
    got = {r.doc_id: r.class_id for r in dart.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
