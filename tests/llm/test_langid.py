import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pointlake.llm import langid

SF = "/root/testdata/sf0.01"


def test_counts_and_clusters():
    assert not langid.counts("").any() and not langid.counts("12 _ 3!").any()
    assert langid.counts("Ab").sum() == 4 + 3 + 2 and (langid.counts("AB, ab") == langid.counts("ab ab")).all()
    rng = np.random.default_rng(0)
    rows = langid.vectors(np.vstack([rng.poisson(m, (40, langid.FEATURES)) for m in np.eye(3, langid.FEATURES)[:, None, :] * 50 + 0.01]), np.ones(langid.FEATURES))
    assert sorted(np.argmax(langid.clustered(rows), axis=1).tolist()) == [0, 1, 2]


def test_frame(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", 1.0) for i in range(40)]
    rows += [(50, None, "en", 1.0), (51, "123", None, 1.0), (51, "123", None, 1.0), (52, "the and " * 40_000, None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, SCORE double")
    model = langid.fit(df)
    out = langid.identified(df, model)
    assert [c.lower() for c in out.columns].count("score") == 1
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and all(got[i].lang_pred == rows[i][2] for i in range(40)) and got[52].lang_pred == "en"
    assert got[50].lang_pred == got[51].lang_pred == "und" and got[50].score == 0.0
    nothing = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.identified(df, nothing).collect()} == {"und"}
    assert langid.identified(df.limit(0), model).count() == 0


def test_copies_count_once_in_the_sample(spark):
    rows = spark.createDataFrame([(f"{a} {b}", "en") for a in ("the cat", "a dog", "quick foxes") for b in ("sleeps", "jumps over", "writes letters", "was here")], "text string, lang string")
    hot = rows.orderBy(F.xxhash64("text")).limit(1).crossJoin(spark.range(300)).select("text", "lang")
    # copies weigh in document frequencies alone, so that only the number of centroids tells that other texts were seen
    assert len(langid.fit(rows.unionByName(hot)).languages) == langid.CENTROIDS


def test_a_language_left_out_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("lang is not null and text is not null")
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~held & (F.col("lang") != "en")))
    rows = langid.identified(docs.where(held | (F.col("lang") == "en")), model).select("lang", "rejected").collect()
    assert np.mean([r.rejected for r in rows if r.lang == "en"]) > 0.95
    assert np.mean([r.rejected for r in rows if r.lang != "en"]) < 0.05


def test_left_out_rows():
    rng = np.random.default_rng(1)
    rows = langid.vectors(rng.poisson(1.0, (7, 40)).astype(float), np.ones(40))
    got = langid.left_out(rows)
    assert len(got) == 7 and len(langid.left_out(rows[:1])) == 0
    assert abs(got[0] - (langid.clustered(rows[[1, 2, 3, 4, 6]]) @ rows[0]).max()) < 1e-12


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = langid.op6_nearest_centroid(spark, SF).collect()
    assert len(rows) == len(lang) and all(r.held_out == langid.in_python(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    held = [lang[r.doc_id] == r.lang_pred for r in rows if r.held_out and lang[r.doc_id]]
    assert np.mean(held) > 0.97 and np.mean([r.rejected for r in rows]) < 0.05


def plain_grams(text):
    """Counts of hashed n-grams, one by one."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    line, mask, out = " " + " ".join(words) + " ", (1 << 64) - 1, Counter()
    if not words:
        return out
    one = lambda c: (ord(c) + 1) * 0x9E3779B97F4A7C15 & mask
    for i, c in enumerate(line):
        out[one(c) >> 52] += 1
        if i + 1 < len(line):
            two = (one(c) ^ one(line[i + 1]) >> 7) * 0xC2B2AE3D27D4EB4F & mask
            out[two >> 52] += 1
            if i + 2 < len(line):
                out[((two ^ one(line[i + 2]) >> 11) * 0x165667B19E3779F9 & mask) >> 52] += 1
    return out


def test_query_against_plain_nearest_centroids(spark):
    """Frequencies, the sample and every score, worked out text by text; only the clustering is shared."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    grams = {r.doc_id: plain_grams(r.text or "") for r in rows}
    learned = [r for r in rows if r.lang is not None and r.text is not None and not langid.in_python(r.doc_id)]
    seen = Counter(f for r in learned for f in grams[r.doc_id])
    idf = [math.log((1 + len(learned)) / (1 + seen[f])) + 1e-3 for f in range(langid.FEATURES)]

    def vector(i):
        v = {f: math.log1p(n) * idf[f] for f, n in grams[i].items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {f: x / norm for f, x in v.items()} if norm else {}

    def h(text):
        n = xxhash.xxh64_intdigest(text.encode(), seed=42)
        return n - (1 << 64) if n >> 63 else n

    centroids = []
    for lang in sorted({r.lang for r in learned}):
        texts = {h(r.text): r.doc_id for r in learned if r.lang == lang}
        dense = np.zeros((min(len(texts), langid.SAMPLE), langid.FEATURES))
        for k, key in enumerate(sorted(texts)[: langid.SAMPLE]):
            for f, x in vector(texts[key]).items():
                dense[k, f] = x
        centroids += [(lang, c) for c in langid.clustered(dense[dense.any(axis=1)])]
    got = {r.doc_id: r for r in langid.op6_nearest_centroid(spark, SF).collect()}
    for r in rows:
        v = vector(r.doc_id)
        cosines = [(sum(x * c[f] for f, x in v.items()), lang) for lang, c in centroids]
        best = max(c for c, _ in cosines)
        assert abs(got[r.doc_id].score - (best if v else 0.0)) < 1e-5
        assert got[r.doc_id].lang_pred in ({lang for c, lang in cosines if c > best - 1e-9} if v else {"und"})
