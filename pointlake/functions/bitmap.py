"""Value bitmaps: 32 equal bins of an attribute's range, one bit each.

Bins and node bitmaps are column expressions over BIGINT; masks of queries are ints.
A mask always covers the bin of a closed upper end, so that pruning loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 32
FULL = (1 << BINS) - 1

Range = tuple[float, float]


def bin_of(value: Column, lo: Column | float, hi: Column | float) -> Column:
    """Bin 0..31 of a value; null outside the range; a range without extent is bin 0."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    place = F.least(F.lit(BINS - 1), F.floor(F.lit(float(BINS)) * (value - lo) / (hi - lo)).cast("int"))
    return F.when((value >= lo) & (value <= hi), F.when(hi > lo, place).otherwise(F.lit(0)))


def bit_of(value: Column, lo: Column | float, hi: Column | float) -> Column:
    """The bit of a value's bin as a BIGINT; 0 outside the range."""
    return F.coalesce(F.expr("bigint(1)") * F.pow(F.lit(2.0), bin_of(value, lo, hi)).cast("long"), F.lit(0).cast("long"))


def bin_width(lo: float, hi: float) -> float:
    return (hi - lo) / BINS


def mask(query: Range, of: Range) -> int:
    """The bins of ``of`` that a closed range can have values in."""
    (a, b), (lo, hi) = query, of
    if a > b or b < lo or a > hi:
        return 0
    if not hi > lo:
        return 1
    first = min(BINS - 1, max(0, math.floor(BINS * (max(a, lo) - lo) / (hi - lo))))
    last = min(BINS - 1, max(first, math.floor(BINS * (min(b, hi) - lo) / (hi - lo))))
    return ((1 << (last - first + 1)) - 1) << first


def mask_of(queries: Sequence[Range], of: Range) -> int:
    """The union over several ranges; all bins if there is none."""
    out = 0
    for q in queries:
        out |= mask(q, of)
    return out if queries else FULL


def mask_column(a: Column, b: Column, lo: Column, hi: Column) -> Column:
    """``mask`` over columns."""
    place = lambda v: F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(F.lit(float(BINS)) * (v - lo) / (hi - lo)).cast("int")))
    first, last = place(F.greatest(a, lo)), place(F.least(b, hi))
    ones = F.pow(F.lit(2.0), last - first + 1).cast("long") - 1
    return F.when((a > b) | (b < lo) | (a > hi), F.lit(0).cast("long")).when(~(hi > lo), F.lit(1).cast("long")).otherwise(ones * F.pow(F.lit(2.0), first).cast("long"))


def remapped(bits: int, of: Range, to: Range) -> int:
    """``bits`` over one range as bins of another: every bin that a value of a set bin can fall in."""
    if of == to or bits in (0, FULL) and of == to:
        return bits
    width, out = bin_width(*of), 0
    for i in range(BINS):
        if bits >> i & 1:
            out |= mask((of[0] + i * width, of[0] + (i + 1) * width), to)
    return out


def remapped_column(bits: Column, lo: Column, hi: Column, to_lo: Column, to_hi: Column) -> Column:
    """``remapped`` over columns."""
    width = (hi - lo) / BINS
    each = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.when(F.getbit(bits, i) == 1, mask_column(lo + i * width, lo + (i + 1) * width, to_lo, to_hi)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def dictionary(df: DataFrame, bits: str) -> DataFrame:
    """(bits, uses, id) of the different bitmaps of ``df``; ids count from 0 in order of use, ties by bits.

    Ranks are made within classes of equal use and shifted by the classes before,
    so that what is ranked in one place is only the number of different uses.
    """
    uses = df.groupBy(F.col(bits).alias("bits")).agg(F.count(F.lit(1)).alias("uses"))
    classes = uses.groupBy("uses").agg(F.count(F.lit(1)).alias("n"))
    past = Window.orderBy(F.desc("uses")).rowsBetween(Window.unboundedPreceding, -1)
    before = classes.select("uses", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("before"))
    inside = Window.partitionBy("uses").orderBy("bits")
    return uses.withColumn("r", F.row_number().over(inside) - 1).join(before, "uses").select("bits", "uses", (F.col("r") + F.col("before")).alias("id"))


def runs(bits: Column) -> Column:
    """Lengths of the runs of set bits, from the highest bit down."""
    return F.transform(F.regexp_extract_all(F.bin(bits), F.lit("(1+)"), F.lit(1)), lambda r: F.length(r))


def leading_zeros(bits: Column) -> Column:
    return F.when(bits == 0, F.lit(BINS)).otherwise(F.lit(BINS) - F.length(F.bin(bits)))
