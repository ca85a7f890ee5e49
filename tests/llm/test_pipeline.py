import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from pointlake.llm import bpe, dartminhash, mixing, qda, secrets

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        outs.append(docs)
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    first = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    all_, kept, single, clean = rows(first), rows(outs[0]), rows(outs[1]), rows(outs[2])

    model = qda.fit(first, spark.read.parquet(f"{SF}/labels.parquet"))
    score = model.scores(np.array([qda.statistics(r.text or "") for r in all_.values()]))
    assert set(kept) == {i for i, s in zip(all_, score) if round(s, 9) >= 0.5}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([i in kept for i in labels if labels[i] == 1]) > 0.98 and np.mean([i in kept for i in labels if labels[i] == 0]) < 0.1

    sets = {i: frozenset(dartminhash.shingles(r.text or "").tolist()) for i, r in kept.items()}
    ids = sorted(sets)
    near = {i: {i} for i in ids}
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x == y or len(x & y) >= 0.8 * len(x | y):
                near[ids[a]].add(ids[b])
                near[ids[b]].add(ids[a])
    want, seen = set(), set()
    for i in ids:
        if i not in seen:
            want.add(i)
            todo = [i]
            while todo:
                if (j := todo.pop()) not in seen:
                    seen.add(j)
                    todo += near[j]
    assert set(single) == want and all(single[i] == kept[i] for i in single)

    assert set(clean) == set(single)
    for i, r in clean.items():
        assert secrets.base_spans(r.text) == [] and r.n_chars == len(r.text)
        if not secrets.base_spans(single[i].text):
            assert "[SECRET]" in r.text or r.text == single[i].text

    times = Counter(r.doc_id for r in outs[3].collect())
    copies = {r.doc_id: r.copies for r in mixing.mixed(outs[2]).collect()}
    words = lambda t: len(dartminhash.WORDS.findall(t or ""))
    assert max(times.values()) <= 3 and set(times) <= set(clean)
    goal = {r.source: (r.target, 0) for r in mixing.mixed(outs[2]).collect()}
    got = Counter()
    for i, n in times.items():
        got[clean[i].source] += n * words(clean[i].text)
    assert all(abs(got[s] - t) <= 0.01 * t for s, (t, _) in goal.items()) and sum(copies.values()) == sum(times.values())

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.RANKS), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = outs[4].collect()
    assert Counter(r.doc_id for r in last) == times
    for r in last:
        assert r.ids == other.encode_ordinary(clean[r.doc_id].text) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(clean[r.doc_id].text.encode()).hexdigest()


def test_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None, "x"), (None, "a b c", "en", "s", 5, "x"), (None, "a b c", "en", "s", 5, "x"), (2, "token = abcdefghijklm " + "w " * 30, "en", "s", 1, "x")], "doc_id long, text string, lang string, source string, n_chars long, Score string")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(n)))
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = spark.read.parquet(str(tmp_path / str(n)))
    assert docs.where("text like '%abcdefghijklm%'").count() == 0
