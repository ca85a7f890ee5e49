"""Quality classifier: regularised quadratic discriminant analysis of text statistics.

Statistics of a text (rates of letters, case, marks, repeats and so on) are made in
Arrow batches and transformed to be near normal. Class counts, means and covariances
come from sums over *all* labelled rows, added up by Spark; only those sums (the
square of the number of statistics) reach the driver. Covariances shrink towards
their diagonal and towards the pooled one, the more the fewer rows there are. A text
is scored by the difference of the classes' log densities; the Cholesky factors are
made once and shipped with the model.

The first pass reads the texts to join statistics with labels, the second scores, so
no text is ever shuffled. Defined cases: a null text is an empty one and gets a score;
labels of one document that disagree count as the lower, null ones not at all; without
both classes every score is 0.5 or more, that is, nothing is rejected; equal texts get
equal scores; an empty table gives an empty table; input columns that clash with an
output column are replaced by it.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import chunks, fresh, map_column, quoted, read_table, without

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS, MARKS, STOPS = "#*$%&|<>@^~{}\\", "!?", ".,;:"
#: Words that are added to each text's denominators, so that a few words do not make an extreme rate.
EASE = 16
NAMES = ("log_words", "mean_word", "symbols", "marks", "stops", "digits", "upper", "not_first", "top_word", "repeats", "dup_lines", "log_line")


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, in the order of NAMES; rates are compressed by a square root."""
    words = WORDS.findall(text)
    n, chars = max(1, len(words)), max(1, len(text))
    root = lambda part, whole: (part / whole) ** 0.5
    count = lambda marks: sum(map(text.count, marks))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    follows = len(set(zip(words, words[1:], words[2:])))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    lower = text.lower()
    pairs = zip(text, lower) if len(lower) == len(text) else zip(text, map(str.lower, text))
    upper = sum(a != b for a, b in pairs) if lower != text else 0
    return [
        np.log1p(len(words)),
        np.log1p((sum(map(len, words)) + 5 * EASE) / (n + EASE)),
        root(count(SYMBOLS), chars + 4 * EASE),
        root(count(MARKS), chars + 4 * EASE),
        root(count(STOPS), chars + 4 * EASE),
        root(count(string.digits), chars + 4 * EASE),
        root(upper, chars + 4 * EASE),
        root(len(words) - len(counts), n + EASE),
        root(max(0, max(counts.values(), default=0) - 1), n + EASE),
        root(max(0, len(words) - 2 - follows), n + EASE),
        root(len(lines) - len(set(lines)), len(lines) + EASE / 2),
        np.log1p(len(words) / max(1, len(lines))),
    ]


@dataclass(frozen=True)
class Model:
    """Per class (0, 1): mean, inverse Cholesky factor of the covariance, log determinant, log prior."""

    means: np.ndarray
    inverses: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row of statistics."""
        if not len(self.means):
            return np.ones(len(rows))
        logs = []
        for mean, inverse, det, prior in zip(self.means, self.inverses, self.log_dets, self.log_priors):
            z = (rows - mean) @ inverse.T
            logs.append(prior - 0.5 * (det + np.einsum("ij,ij->i", z, z)))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit_sums(counts: dict[int, int], sums: dict[int, np.ndarray], products: dict[int, np.ndarray], shrink: float = 0.1, pooled: float = 0.1) -> Model:
    """From each class's count, sum and sum of outer products."""
    d = len(NAMES)
    empty = Model(np.empty((0, d)), np.empty((0, d, d)), np.empty(0), np.empty(0))
    if min(counts.get(0, 0), counts.get(1, 0)) < 2:
        return empty
    total = counts[0] + counts[1]
    means = {c: sums[c] / counts[c] for c in (0, 1)}
    scatter = {c: products[c] - counts[c] * np.outer(means[c], means[c]) for c in (0, 1)}
    common = (scatter[0] + scatter[1]) / total
    floor = 1e-3 * max(np.trace(common) / d, 1e-6)
    inverses, dets = [], []
    for c in (0, 1):
        own = scatter[c] / counts[c]
        a = min(1.0, pooled + d * d / counts[c] / 4)
        cov = (1 - a) * own + a * common
        b = min(1.0, shrink + d / counts[c])
        cov = (1 - b) * cov + b * np.diag(np.diag(cov)) + floor * np.eye(d)
        factor = np.linalg.cholesky(cov)
        inverses.append(np.linalg.solve(factor, np.eye(d)))
        dets.append(2 * np.log(np.diag(factor)).sum())
    return Model(np.array([means[0], means[1]]), np.array(inverses), np.array(dets), np.log([counts[0] / total, counts[1] / total]))


def with_statistics(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with a struct whose field ``x`` holds the statistics."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [statistics(t) for texts in chunks(batch) for t in texts]
            yield pa.StructArray.from_arrays([pa.array(rows, pa.list_(pa.float64()))], ["x"])

    return map_column(df, text_col, run, "x array<double>", out)


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", learn_from: Column | None = None) -> Model:
    """The model of the labelled documents; ``learn_from`` (on the id) leaves some of them out.

    Sums are in hundred-millionths held as decimals, which add up to the same in any order.
    """
    d, x, label = len(NAMES), fresh(docs, "x", labels), fresh(docs, "label", labels)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias(label))
    rows = docs.select(id_col, text_col).where(F.col(id_col).isNotNull() if learn_from is None else learn_from)
    rows = with_statistics(rows, text_col, x).select(id_col, F.col(x)["x"].alias(x)).join(known, id_col)
    exact = lambda v: F.sum(F.round(v, 8).cast("decimal(18,8)")).cast("double")
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    made = F.array(*[F.col(x)[i] for i in range(d)], *[F.col(x)[i] * F.col(x)[j] for i, j in pairs])
    cells = rows.select(label, F.posexplode(made).alias("i", "v")).groupBy(label, "i").agg(F.count(F.lit(1)).alias("n"), exact(F.col("v")).alias("s"))
    counts: dict[int, int] = {}
    sums = {c: np.zeros(d) for c in (0, 1)}
    products = {c: np.zeros((d, d)) for c in (0, 1)}
    for r in cells.collect():
        counts[r[label]] = r.n
        if r.i < d:
            sums[r[label]][r.i] = r.s
        else:
            i, j = pairs[r.i - d]
            products[r[label]][i, j] = products[r[label]][j, i] = r.s
    return fit_sums(counts, sums, products)


def scored(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability that a text is of class 1."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = np.array([statistics(t) for texts in chunks(batch) for t in texts]).reshape(-1, len(NAMES))
            yield pa.StructArray.from_arrays([pa.array(np.round(model.scores(rows), 9))], ["score"])

    made = fresh(df, "score")
    rest = [quoted(c) for c in df.columns if c.lower() != out.lower()]
    return map_column(df, text_col, run, "score double", made).select(*rest, F.col(made)["score"].alias(out))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from; a null id has no remainder and is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(True))


def op9_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"), learn_from=~held_out(F.col("doc_id")))
    out = without(scored(docs, model), ["text"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def in_python(doc_id: int) -> bool:
    """``held_out`` for one id, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
