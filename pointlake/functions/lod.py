"""Levels of detail: quality to depth, and the interval predicate of progressive queries.

Every row has ``lod_level`` (depth of the node that owns it), ``lod_idx`` (its place in
the node) and ``lod_cnt`` (the node's rows). Two qualities select the rows between them;
successive intervals are disjoint and add up to the whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that represent a node.
NODE_ROWS = 8


def remap_quality(quality: float) -> float:
    """Quality as asked for to quality as used: logarithmic, so that it is nearer to the share of rows."""
    return min(1.0, max(0.0, math.log10(1 + 9 * min(1.0, max(0.0, quality)))))


def depth(quality: float, deepest: int) -> tuple[int, float]:
    """(whole levels, fraction of the next) for a remapped quality and levels 0..deepest."""
    at = min(float(deepest + 1), max(0.0, quality * (deepest + 1)))
    whole = math.floor(at)
    return whole, at - whole


def interval(previous: float, quality: float, deepest: int, level: Column, idx: Column, cnt: Column) -> Column:
    """Rows that quality ``quality`` has and ``previous`` has not."""
    if previous == quality and quality != 0 or quality <= previous:
        return F.lit(False)
    (d0, f0), (d1, f1) = (depth(remap_quality(q), deepest) for q in (previous, quality))
    return above(level, idx, cnt, d0, f0) & below(level, idx, cnt, d1, f1)


def above(level: Column, idx: Column, cnt: Column, whole: int, part: float) -> Column:
    if whole == 0 and part == 0:
        return F.lit(True)
    return (level > whole) | ((level == whole) & (idx >= F.floor(cnt * F.lit(part))))


def below(level: Column, idx: Column, cnt: Column, whole: int, part: float) -> Column:
    if part == 0:
        return level < whole
    return (level < whole) | ((level == whole) & (idx < F.floor(cnt * F.lit(part))))


def deepest_level(rows: int) -> int:
    """The last level of a cell of ``rows`` rows as ``assigned`` deals them."""
    return ((max(1, rows) - 1) // NODE_ROWS + 1).bit_length() - 1


#: Rows of a part that one task ranks, about.
PART_ROWS = 1 << 20


def digits_for(rows: int) -> int:
    """Hex digits that cut a cell of ``rows`` rows into parts of PART_ROWS or fewer."""
    return max(0, math.ceil(math.log(max(1, rows / PART_ROWS), 16) - 1e-9))


def assigned(df: DataFrame, cells: list[str], pid: str, digits: int = 1) -> DataFrame:
    """``df`` with lod_level, lod_idx and lod_cnt: in each cell, rows in the order of md5(pid), levels of 8, 16, 32 and so on.

    The order is a hash's, so its leading hex digits cut a cell into even parts
    that are in order among themselves: each part is ranked alone and shifted by
    the counts of those before. No cell, however large, is one task's sort.
    """
    h = F.md5(F.col(pid).cast("string"))
    marked = df.withColumn("__h", h).withColumn("__p", F.substring("__h", 1, digits))
    sizes = marked.groupBy(*cells, "__p").agg(F.count(F.lit(1)).alias("__c"))
    past = Window.partitionBy(*cells).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*cells)
    sizes = sizes.select(*cells, "__p", F.coalesce(F.sum("__c").over(past), F.lit(0)).alias("__b"), F.sum("__c").over(all_).alias("__n"))
    inside = Window.partitionBy(*cells, "__p").orderBy("__h")
    ranked = marked.withColumn("__r", F.row_number().over(inside) - 1).join(sizes, [*cells, "__p"]).withColumn("__r", F.col("__r") + F.col("__b"))
    return with_levels(ranked, "__r", "__n").drop("__h", "__p", "__b", "__n", "__r")


def with_levels(df: DataFrame, rank: str, rows: str) -> DataFrame:
    """``df`` with the level columns of a rank within ``rows`` rows."""
    level = (F.length(F.bin(F.floor(F.col(rank) / NODE_ROWS) + 1)) - 1).cast("int")
    out = df.withColumn("lod_level", level)
    size = F.pow(F.lit(2.0), F.col("lod_level")).cast("long") * NODE_ROWS
    base = size - NODE_ROWS
    return out.withColumn("lod_idx", F.col(rank).cast("long") - base).withColumn("lod_cnt", F.least(size, F.col(rows).cast("long") - base))
