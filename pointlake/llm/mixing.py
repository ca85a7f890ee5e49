"""Mixing sources to target weights by entropy balancing.

Every document gets a rate (expected copies) close to 1 in relative entropy such that
each source's words, rate times size, meet its target: the solution of that convex
problem is an exponential tilt, rate = min(most, exp(lambda * size)), with one dual
variable per source. The duals come from damped Newton iterations, each one a
distributed aggregate over the table of (source, size, number of documents): documents
of one source and size have the same rate, so the table is the data without loss and no
larger than the number of different sizes. Sums are decimals, which add up to the same
in any order, so that reruns agree to the last digit.

Rates become copies without drawing lots for each document: a cell of (source, size)
gets the whole number of extra copies that the words owed by its source so far allow,
largest sizes first, and the documents that come first by hash take them. A rank by hash
within a cell is made in salted parts, so that a cell of any size is spread.

Defined cases: a null text has no words and takes none; a null source is a source, the
last; a source without words has target 0; repeated rows are documents like others and
split the copies of their cell; one source of any share of the rows is a few cells;
an empty table gives an empty table; input columns that clash with an output column
are replaced by it.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointlake.llm.common import cut, fresh, quoted, read_table, spent
from pointlake.llm.wordstats import word_count

WEIGHTS = (5, 2, 1)
MOST = 3
SALTS = 64
#: Newton steps at most, and the relative error at which a source is done.
STEPS, DONE = 60, 1e-7


def _place(sources: DataFrame, key: str, out: str) -> DataFrame:
    """``sources`` with the position of ``key`` in code point order, from 0; null last.

    One row a source: ranked within ranges of the sorted keys, shifted by the
    sizes of the ranges before.
    """
    part, before, n = (fresh(sources, x) for x in ("part", "before", "n"))
    ordered = [F.col(key).isNull(), F.col(key)]
    placed = cut(sources.repartitionByRange(*ordered).withColumn(part, F.spark_partition_id()))
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    past = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum(n).over(past), F.lit(0)).alias(before))
    inside = Window.partitionBy(part).orderBy(*ordered)
    return placed.withColumn(out, F.row_number().over(inside) - 1).join(starts, part).withColumn(out, F.col(out) + F.col(before)).drop(part, before)


def targets(sources: DataFrame, key: str, size: str, out: str, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (one row each, with their size) with each one's target.

    Weights repeat over the sources in code point order. A source stops at
    ``most`` times its size; what is beyond goes to the others by weight, until
    none is above.
    """
    w = fresh(sources, "w")
    pos = fresh(sources, "pos")
    placed = _place(sources, key, pos)
    cycle = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col(pos), F.lit(len(weights))) + 1).cast("int"))
    known = cut(placed.withColumn(w, cycle).drop(pos))
    level, full = 0.0, -1
    while True:
        cap = F.col(size) * most
        over = F.lit(level) * F.col(w) >= cap
        got = known.agg(F.sum(size).alias("total"), F.sum(F.when(over, cap)).alias("fixed"), F.sum(F.when(~over, F.col(w))).alias("free"), F.sum(over.cast("long")).alias("full")).first()
        if not got.total or not got.free:
            break
        if got.full == full and level:
            break
        level, full = (got.total - (got.fixed or 0)) / got.free, got.full
    share = F.least(F.lit(level) * F.col(w), (F.col(size) * most).cast("double"))
    return known.withColumn(out, F.when(F.col(size) > 0, share).otherwise(F.lit(0.0))).drop(w)


def rate(dual: Column, size: Column, scale: Column, most: int = MOST) -> Column:
    """Copies expected of a document: the tilt by its share of its source's largest size."""
    return F.exp(F.least(dual * size / scale, F.log(F.lit(float(most)))))


def duals(cells: DataFrame, goals: DataFrame, most: int = MOST, steps: int = STEPS, done: float = DONE) -> DataFrame:
    """(source, null_source, dual, scale): the tilt that meets each goal.

    ``cells``: source, null_source, size, docs; ``goals``: source, null_source,
    target. Newton's step is taken where it stays inside the bracket found so
    far; otherwise the bracket is halved, or widened while it is open.
    """
    key = ["source", "null_source"]
    scales = cells.where("size > 0").groupBy(*key).agg(F.max("size").alias("scale"), F.sum(F.col("size") * F.col("docs")).alias("words"))
    state = cut(goals.join(scales, key).where("target > 0").select(*key, "target", "scale", "words", F.lit(0.0).alias("dual"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), (F.col("target") >= most * F.col("words") * (1 - 1e-9)).alias("over")))
    state = cut(state.withColumn("dual", F.when(F.col("over"), F.lit(1e9)).otherwise(F.col("dual"))))
    exact = lambda v: F.sum(F.round(v, 6).cast("decimal(38,6)")).cast("double")
    positive = cells.where("size > 0")
    for _ in range(steps):
        if state.where("not over").isEmpty():
            break
        x = F.col("size") / F.col("scale")
        each = positive.join(state.where("not over").select(*key, "dual", "scale"), key)
        words = F.col("docs") * F.col("size") * rate(F.col("dual"), F.col("size"), F.col("scale"), most)
        inner = F.col("dual") * x < F.log(F.lit(float(most)))
        sums = each.groupBy(*key).agg(exact(words).alias("at"), exact(F.when(inner, words * x).otherwise(F.lit(0.0))).alias("slope"))
        now = state.join(sums, key, "left")
        gap = F.col("at") - F.col("target")
        lo = F.when(gap < 0, F.col("dual")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("dual")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("dual") - gap / F.col("slope"))
        wide = F.abs(F.col("dual")) + 1
        inside = newton.isNotNull() & (newton > F.coalesce(lo, F.col("dual") - 8 * wide)) & (newton < F.coalesce(hi, F.col("dual") + 8 * wide))
        other = F.when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2).when(gap > 0, F.col("dual") - 2 * wide).otherwise(F.col("dual") + 2 * wide)
        ended = F.col("over") | (F.abs(gap) <= done * F.col("target"))
        last, state = state, cut(now.select(*key, "target", "scale", "words", F.when(ended, F.col("dual")).when(inside, newton).otherwise(other).alias("dual"), lo.alias("lo"), hi.alias("hi"), ended.alias("over")))
        spent(last)
    else:
        if left := state.where("not over").count():
            logging.getLogger(__name__).warning("%d of the duals are not within %g after %d steps; the last ones are used", left, done, steps)
    return state.select(*key, "dual", "scale")


def rounded(cells: pd.DataFrame) -> pd.DataFrame:
    """One source's cells (as many as it has sizes) with whole and extra copies.

    Largest sizes first: each cell takes the extra copies that the words owed so far
    allow, and what is left is owed by the next, smaller size.
    """
    cells = cells.sort_values("size", ascending=False, ignore_index=True)
    whole = np.floor(cells["rate"].to_numpy()).astype(np.int64)
    sizes, rooms = cells["size"].tolist(), np.where((whole >= MOST) | (cells["size"] == 0), 0, cells["docs"]).tolist()
    extra, owed = [0] * len(sizes), 0.0
    for i, more in enumerate(((cells["rate"] - whole) * cells["size"] * cells["docs"]).tolist()):
        owed += more
        extra[i] = min(rooms[i], int(owed // sizes[i])) if sizes[i] else 0
        owed -= extra[i] * sizes[i]
    most = ((MOST - whole) * cells["docs"]).tolist()
    for _ in range(8):  # what no smaller size had room for: one copy more, or one for another, where that is nearer
        more = [i for i in reversed(range(len(sizes))) if sizes[i] and extra[i] < most[i]]
        less = [None, *(i for i in range(len(sizes)) if extra[i])]
        if not more or abs(owed) < 1:
            break
        ascending = np.array([sizes[i] for i in more])
        wish = np.array([owed + (0 if i is None else sizes[i]) for i in less])
        at = np.clip(np.searchsorted(ascending, wish), 1, max(1, len(more) - 1))
        pick = np.where(np.abs(ascending[at - 1] - wish) <= np.abs(ascending[np.minimum(at, len(more) - 1)] - wish), at - 1, np.minimum(at, len(more) - 1))
        best = int(np.argmin(np.abs(ascending[pick] - wish)))
        left = float(wish[best] - ascending[pick[best]])
        if abs(left) >= abs(owed):
            break
        owed = left
        extra[more[pick[best]]] += 1
        if less[best] is not None:
            extra[less[best]] -= 1
    return cells[["source", "null_source", "size", "docs", "source_size", "target"]].assign(whole=whole, extra=np.array(extra, np.int64))


def mixed(df: DataFrame, text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``df`` without ``text_col`` and with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``taken`` is copies times size. Columns of those names are replaced.
    """
    names = ["size", "source_size", "target", "copies", "taken"]
    rest = [c for c in df.columns if c.lower() not in {*names, text_col.lower()}]
    packed = fresh(df, "row")
    rows = cut(df.select(F.struct(*[quoted(c) for c in rest]).alias(packed), quoted(source_col).alias("source"), word_count(quoted(text_col)).alias("size")))
    # a null source cannot be a join key: an empty text and a flag stand for it
    flag = F.col("source").isNull()
    salt = F.pmod(F.xxhash64(packed), F.lit(SALTS)).cast("int")
    rows = rows.select(packed, F.coalesce("source", F.lit("")).alias("source"), flag.alias("null_source"), "size", salt.alias("salt"))
    parts = cut(rows.groupBy("source", "null_source", "size", "salt").agg(F.count(F.lit(1)).alias("docs")))
    key = ["source", "null_source"]
    cells = cut(parts.groupBy(*key, "size").agg(F.sum("docs").alias("docs")))
    sources = cells.groupBy(*key).agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    named = sources.withColumn("name", F.when(~F.col("null_source"), F.col("source")))
    goals = cut(targets(named, "name", "source_size", "target", weights, most).drop("name"))
    found = duals(cells, goals, most)

    # copies by cell: whole parts for all, and as many extra ones as keep the running total exact
    each = cells.join(goals, key).join(found, key, "left")
    each = each.withColumn("rate", F.when(F.col("dual").isNull() | (F.col("size") == 0), F.when(F.col("target") > 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.round(rate(F.col("dual"), F.col("size"), F.col("scale"), most), 9)))
    each = cut(each.groupBy(*key).applyInPandas(rounded, "source string, null_source boolean, size long, docs long, source_size long, target double, whole long, extra long"))

    # the first ``extra`` documents of a cell, by hash, take one copy more
    salts = Window.partitionBy(*key, "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("before", F.coalesce(F.sum("docs").over(salts), F.lit(0))).drop("docs").join(each, [*key, "size"])
    inside = Window.partitionBy(*key, "size", "salt").orderBy(F.xxhash64(packed, F.lit(7)))
    out = rows.withColumn("nth", F.row_number().over(inside) - 1).join(starts, [*key, "size", "salt"])
    rank = F.col("nth") + F.col("before")
    copies = F.col("whole") + F.floor(F.col("extra") / F.col("docs")) + (rank < F.col("extra") % F.col("docs")).cast("long")
    out = out.select(packed, F.col("size"), F.col("source_size"), F.col("target"), copies.cast("long").alias("copies"))
    return out.select(*[F.col(packed)[c].alias(c) for c in rest], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(df: DataFrame, text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each row of ``df`` as often as it is taken.

    The copies are decided on a hash of each row, so that texts are shuffled once,
    to meet their number; rows that repeat share what falls to them.
    """
    k, total, rows = (fresh(df, x) for x in ("k", "total", "rows"))
    marked = df.withColumn(k, F.xxhash64(*[quoted(c) for c in df.columns]))
    taken = mixed(marked.select(k, quoted(source_col).alias("source"), quoted(text_col).alias("text")), "text", "source", weights, most)
    number = cut(taken.groupBy(k).agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(rows)).where(F.col(total) > 0))
    nth = F.row_number().over(Window.partitionBy(k).orderBy(k))
    met = marked.join(number, k).withColumn(total, F.floor(F.col(total) / F.col(rows)) + (nth <= F.col(total) % F.col(rows)).cast("long"))
    again = F.explode(F.array_repeat(F.lit(1), F.col(total).cast("int")))
    return met.select(*[quoted(c) for c in df.columns], again.alias(rows)).drop(rows)


def op4_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
