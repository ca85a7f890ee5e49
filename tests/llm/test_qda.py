import numpy as np

from pointlake.llm import qda

SF = "/root/testdata/sf0.01"


def test_statistics_of_odd_texts():
    for text in ("", " \n", "a", "İ" * 10, "x" * 300_000, "a b\na b\n", "!!!???"):
        assert len(qda.statistics(text)) == len(qda.NAMES) and np.isfinite(qda.statistics(text)).all()


def test_capitals_count_where_lower_case_is_longer():
    at = qda.NAMES.index("upper")
    assert qda.statistics("BÜYÜK İSTANBUL ve")[at] == qda.statistics("BÜYÜK ISTANBUL ve")[at] > 0


def test_model_against_plain_densities():
    rng = np.random.default_rng(7)
    d = len(qda.NAMES)
    x = {0: rng.normal(1, 2, (4000, d)), 1: rng.normal(0, 1, (6000, d))}
    m = qda.fit_sums({c: len(v) for c, v in x.items()}, {c: v.sum(0) for c, v in x.items()}, {c: v.T @ v for c, v in x.items()}, shrink=0.0, pooled=0.0)
    rows = rng.normal(0.5, 1.5, (50, d))
    logs = []
    for c, prior in ((0, 0.4), (1, 0.6)):
        cov = np.cov(x[c].T, bias=True)
        diff = rows - x[c].mean(0)
        logs.append(np.log(prior) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff))
    plain = logs[1] - logs[0]
    score = np.clip(m.scores(rows), 1e-12, 1 - 1e-12)
    assert np.corrcoef(np.log(score / (1 - score)), plain)[0, 1] > 0.99
    assert ((score >= 0.5) == (plain >= 0)).mean() > 0.9


def test_frame_without_labels(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (1, "a b", 0.1), (None, "c", 0.1)], "doc_id long, text string, SCORE double")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    out = qda.scored(docs, qda.fit(docs, labels))
    assert out.columns == ["doc_id", "text", "score"] and [r.score for r in out.collect()] == [1.0] * 3
    assert qda.scored(docs.limit(0), qda.fit(docs, labels)).count() == 0


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = qda.op9_quadratic_discriminant(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == qda.in_python(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.97 and np.mean([p for q, p in held if q == 0]) < 0.1


def test_scores_against_a_refit_of_the_rows(spark):
    """The query's scores against densities worked out from the labelled rows themselves, without sums or factors."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    x = {i: np.array(qda.statistics(t or "")) for i, t in docs.items()}
    own = {c: np.array([x[i] for i in sorted(x) if labels.get(i) == c and not qda.in_python(i)]) for c in (0, 1)}
    d, total = len(qda.NAMES), sum(map(len, own.values()))
    cov = {c: np.cov(v.T, bias=True) for c, v in own.items()}
    pooled = sum(len(own[c]) * cov[c] for c in cov) / total
    logs = {}
    for c, v in own.items():
        a = min(1.0, 0.1 + d * d / len(v) / 4)
        m = (1 - a) * cov[c] + a * pooled
        b = min(1.0, 0.1 + d / len(v))
        m = (1 - b) * m + b * np.diag(np.diag(m)) + 1e-3 * max(np.trace(pooled) / d, 1e-6) * np.eye(d)
        inverse, base = np.linalg.inv(m), np.log(len(v) / total) - 0.5 * np.linalg.slogdet(m)[1]
        logs[c] = {i: base - 0.5 * float((r - v.mean(0)) @ inverse @ (r - v.mean(0))) for i, r in x.items()}
    for r in qda.op9_quadratic_discriminant(spark, SF).collect():
        assert abs(r.score - 1 / (1 + np.exp(np.clip(logs[0][r.doc_id] - logs[1][r.doc_id], -700, 700)))) < 1e-4
