"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.

1. quality classifier: documents that the quadratic discriminant rejects go;
2. MinHash near-dedup: of each class of near duplicates the first document stays;
3. secret scans: spans of secrets are replaced, and ``n_chars`` follows the text;
4. mixing: each document is repeated as often as the entropy-balanced mix takes it;
5. byte-level BPE: token ids, their number and digests of the round trip.

Defined cases: a null text is judged as an empty one; rows without an id take part like
others; a table without rows, or that loses all of them, goes on as an empty one; other
columns of ``documents`` are carried through stages 1 to 4.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm import bpe, dartminhash, mixing, qda, secrets
from pointlake.llm.common import fresh, quoted, read_table
from pointlake.storage import delete, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject what the classifier, learned from all labels of these documents, gives class 0."""
    model = qda.fit(docs, read_table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return qda.scored(docs, model, out=score).where(F.col(score) >= 0.5).select(*map(quoted, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dartminhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redacted(docs, secrets.fit(docs))
    length = F.when(F.col("text").isNotNull(), F.length("text").cast("long"))
    return clean.select(*[length.alias(c) if c.lower() == "n_chars" else quoted(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs.select("doc_id", "text"), with_ids=True).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: A discriminant fitted on the data, connected components, inferred automata, Newton steps and BPE are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        delete(spark, f"{folder}/{n - 1}")  # read by the stage that has just ended, and by no other
    return docs
