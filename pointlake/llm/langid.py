"""Language identification by nearest centroids of n-gram TF-IDF vectors.

A text is the hashed counts of its letters' n-grams (one to three characters of lower
case, words set apart), weighted by inverse document frequency and normalised. Document
frequencies are counted over *all* documents to learn from, in partial sums a task; each
language's vectors are then clustered (spherical k-means) into several centroids, from a
bounded sample, SAMPLE different texts a language by lowest hash. A text goes to the language
of the nearest centroid by cosine; its score is that cosine, and a text farther from it
than nearly all of the centroid's own sample (all but the share FAR) is marked as rejected.
How far the sample is, is measured on centroids made without the row: a language's sample
is dealt into FOLDS parts, and each is held against clusters of the others. A centroid
that is nearest to no row takes the distance of its language, a language of one text that
of all languages; if there is none, nothing is rejected.

The driver gets the frequencies (one number a feature), the sample and nothing else;
scoring is row by row. Defined cases: a null text or one without a letter is ``und``,
score 0; without anything learned all are ``und``; languages that tie go to the first by
name; equal texts get equal answers; an empty table gives an empty table; input columns
that clash with an output column are replaced by it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointlake.llm.common import chunks, fresh, map_column, quoted, read_table, without

FEATURES, SAMPLE, CENTROIDS, PASSES = 1 << 12, 200, 3, 10
FOLDS, FAR = 5, 0.01
LETTERS = re.compile(r"[^\W\d_]+")
#: Characters hashed at once.
BLOCK = 1 << 18
U = np.uint64


def counts(text: str) -> np.ndarray:
    """Hashed counts of the letters' n-grams, one to three characters, over the whole text."""
    words = LETTERS.findall(text.lower())
    if not words:
        return np.zeros(FEATURES)
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(FEATURES)
    for start in range(0, len(points), BLOCK):  # n-grams that begin in this block
        c, n = points[start : start + BLOCK + 2].astype(U), min(BLOCK, len(points) - start)
        with np.errstate(over="ignore"):
            one = (c + U(1)) * U(0x9E3779B97F4A7C15)
            two = (one[:-1] ^ (one[1:] >> U(7))) * U(0xC2B2AE3D27D4EB4F)
            three = (two[:-1] ^ (one[2:] >> U(11))) * U(0x165667B19E3779F9)
        ids = np.concatenate([one[:n] >> U(52), two[:n] >> U(52), three[:n] >> U(52)]).astype(np.int64)
        out += np.bincount(ids, minlength=FEATURES)
    return out


def vectors(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear term frequencies times idf, each row of length 1 (or 0)."""
    out = np.log1p(rows) * idf
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


@dataclass(frozen=True)
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    floors: np.ndarray  # cosine below which a text is rejected
    idf: np.ndarray

    def judge(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        names, scores, far = [], [], []
        for i in range(0, len(texts), 256):
            rows = np.array([counts(t) for t in texts[i : i + 256]])
            if not self.languages:
                near, best = None, np.zeros(len(rows))
            else:
                cos = vectors(rows, self.idf) @ self.centroids.T
                near, best = cos.argmax(axis=1), cos.max(axis=1)
            for j, row in enumerate(rows):
                known = near is not None and row.any()
                names.append(self.languages[near[j]] if known else "und")
                scores.append(round(float(min(1.0, max(0.0, best[j]))), 6) if known else 0.0)
                far.append(bool(known and best[j] < self.floors[near[j]]) or not known)
        return names, scores, far


def clustered(rows: np.ndarray, k: int = CENTROIDS, passes: int = PASSES) -> np.ndarray:
    """Spherical k-means: first centres far apart, no chance involved."""
    k = min(k, len(rows))
    first = int(np.argmax(rows @ rows.sum(axis=0)))
    centres = [rows[first]]
    while len(centres) < k:
        centres.append(rows[int(np.argmin((rows @ np.array(centres).T).max(axis=1)))])
    out = np.array(centres)
    for _ in range(passes):
        near = (rows @ out.T).argmax(axis=1)
        out = np.array([m / n if (n := np.linalg.norm(m := rows[near == i].sum(axis=0))) > 0 else out[i] for i in range(k)])
    return out


def left_out(rows: np.ndarray, folds: int = FOLDS) -> np.ndarray:
    """Each row's cosine to the nearest of the centroids that the other folds' rows make; none for a single row."""
    folds = min(folds, len(rows))
    if folds < 2:
        return np.empty(0)
    fold, out = np.arange(len(rows)) % folds, np.empty(len(rows))
    for i in range(folds):
        out[fold == i] = (rows[fold == i] @ clustered(rows[fold != i]).T).max(axis=1)
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, sample: int = SAMPLE) -> Model:
    """The model of ``docs`` with a language; ``key`` orders rows for the sample (default: the text's hash)."""
    rows = docs.where(quoted(lang_col).isNotNull() & quoted(text_col).isNotNull())
    rows = rows.select(quoted(lang_col).alias("lang"), quoted(text_col).alias("text"), (F.xxhash64(text_col) if key is None else key).alias("h"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for texts in chunks(batch.column(0)):
                for t in texts:
                    seen += counts(t) > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1, dtype=np.int32)), pa.array(np.append(seen, n))], names=["f", "df"])

    found = rows.select("text").mapInArrow(tally, "f int, df long").groupBy("f").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(FEATURES + 1)
    for r in found:
        df[r.f] = r.df
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1e-3
    # the sample: lowest hashes of a language, copies counted once, found without moving a text: in ever fewer parts of the hash, then of all
    near = rows.select("lang", "h").distinct()
    for parts in (512, 64, 8, 1):
        lowest = Window.partitionBy("lang", F.pmod(F.col("h"), F.lit(parts))).orderBy("h")
        near = near.withColumn("r", F.row_number().over(lowest)).where(F.col("r") <= sample).drop("r")
    limits = near.groupBy("lang").agg(F.max("h").alias("most")).collect()
    chosen = F.lit(False)
    for r in limits:  # one row a language, as the model has
        chosen = chosen | ((F.col("lang") == r.lang) & (F.col("h") <= r.most))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [counts(t).astype(np.int32) for texts in chunks(batch.column(2)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.int32()))], names=["lang", "h", "n"])

    drawn = rows.where(chosen).select("lang", "h", "text").mapInArrow(draw, "lang string, h long, n array<int>").dropDuplicates(["lang", "h"])
    by: dict[str, list[tuple[int, list[int]]]] = {}
    for r in drawn.collect():
        by.setdefault(r.lang, []).append((r.h, r.n))
    names, centres, near, apart = [], [], [], []
    for lang in sorted(by):
        own = vectors(np.array([n for _, n in sorted(by[lang])], np.float64), idf)
        own = own[own.any(axis=1)]
        if len(own):
            made, cos = clustered(own), left_out(own)
            of = (own @ made.T).argmax(axis=1)
            names += [lang] * len(made)
            centres += list(made)
            near += [cos[of == i] if len(cos) and (of == i).any() else cos for i in range(len(made))]
            apart.append(cos)
    every = np.concatenate(apart) if apart else np.empty(0)
    floors = [float(np.quantile(mine if len(mine) else every, FAR)) if len(every) else 0.0 for mine in near]
    return Model(names, np.array(centres).reshape(-1, FEATURES), np.array(floors), idf)


def identified(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``rejected``."""
    names = {"lang_pred": pa.string(), "score": pa.float64(), "rejected": pa.bool_()}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            got: tuple[list, list, list] = ([], [], [])
            for texts in chunks(batch):
                for all_, new in zip(got, model.judge(texts)):
                    all_ += new
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(got, names.values())], list(names))

    made = fresh(df, "lang")
    rest = [quoted(c) for c in df.columns if c.lower() not in names]
    out = map_column(df, text_col, run, "lang_pred string, score double, rejected boolean", made)
    return out.select(*rest, *[F.col(made)[n].alias(n) for n in names])


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; a null id has no remainder and is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


def in_python(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def op6_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    out = without(identified(docs.select("doc_id", "text"), model), ["text"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
