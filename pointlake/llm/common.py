"""Helpers shared by the text operators: names, kept tables, columns through Arrow.

Nothing here reads files behind Spark's back: tables come in as DataFrames and
intermediate results go to the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.storage import delete, scratch

#: Spelled as in the contracts: everything but space and 0x09-0x0D is part of a word.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BREAKS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str, *more: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case."""
    taken = {c.lower() for d in (df, *more) for c in d.columns}
    name, n = f"__{base}", 0
    while name.lower() in taken:
        n += 1
        name = f"__{base}_{n}"
    return name


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` less the columns that outputs called ``names`` would clash with."""
    gone = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in gone])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


#: Arrow batches while a table is kept: smaller than by default, as a worker holds a batch and what it makes of it.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
_SETTING = threading.Lock()
#: By application: how many tables are being kept now, and the settings to go back to after the last of them.
_KEEPING: dict[str, tuple[int, dict[str, str]]] = {}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """BATCHES for as long as anyone in the session is inside; the first sets them, the last sets them back."""
    key = f"{spark.sparkContext.applicationId} {spark._jsparkSession.hashCode()}"
    with _SETTING:
        inside, before = _KEEPING.get(key, (0, {}))
        if not inside:
            before = {k: spark.conf.get(k) for k in BATCHES}
            for k, v in BATCHES.items():
                spark.conf.set(k, v)
        _KEEPING[key] = (inside + 1, before)
    try:
        yield
    finally:
        with _SETTING:
            inside, before = _KEEPING[key]
            _KEEPING[key] = (inside - 1, before)
            if inside == 1:
                for k, v in before.items():
                    spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a table in the shared folder; its lineage ends there.

    A written table, not ``checkpoint()``: a checkpoint keeps the size estimates of
    the plan it cut, which joins multiply, so that in a loop they grow to numbers
    that fill the driver's memory. A table has the size of its files, by which
    Spark then chooses its joins. It goes when it is ``spent``, or with the
    application.
    """
    spark = df.sparkSession
    path = scratch(spark, "kept")
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def spent(*tables: DataFrame) -> None:
    """Delete kept tables that nothing will read any more; others are left alone."""
    for df in tables:
        if path := getattr(df, "_kept_at", None):
            delete(df.sparkSession, path)


def map_column(
    df: DataFrame,
    column: str,
    fn: Callable[[Iterator[pa.Array]], Iterator[pa.Array]],
    ddl: str,
    out: str,
) -> DataFrame:
    """``df`` with the struct column ``out`` that ``fn`` makes of ``column``, batch by batch.

    Only that one column goes through Arrow. The function is marked as not
    deterministic so that the optimizer never evaluates it once per field.
    """

    def typed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from fn(batches)

    typed.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(typed, ddl).asNondeterministic()
    return df.withColumn(out, udf(quoted(column)))


#: Rows that a worker takes on at a time, whatever the session's batches.
PART = 2000
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", lambda keep: 0)  # glibc has it


def give_back() -> None:
    """Give the memory that this process holds free back to the system."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def in_parts(batches: Iterable[pa.Array]) -> Iterator[pa.Array]:
    """The batches in parts of PART rows at most; before each and at the end, free memory is given back.

    So what a worker needs does not grow with the batches it is sent, and what it
    needed for one stage does not stay with it in the next ones.
    """
    for batch in batches:
        for at in range(0, max(1, len(batch)), PART):
            give_back()
            yield batch.slice(at, PART)
    give_back()


def chunks(texts: pa.Array, most_bytes: int = 1 << 22) -> Iterator[list[str]]:
    """The texts of a batch in runs of bounded size; null is the empty text."""
    run, held = [], 0
    for text in texts:
        value = text.as_py() or ""
        if run and held + len(value) > most_bytes:
            yield run
            run, held = [], 0
        run.append(value)
        held += len(value)
    if run:
        yield run
