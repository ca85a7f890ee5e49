"""Morton (Z-order) codes and coarse cells as column expressions.

Bit 0 of the code is x, bit 1 y, bit 2 z; BITS bits an axis. Nothing here is a UDF, so
that Catalyst can fold, push and compile what it is given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions.geometry import Box

BITS = 10
COARSE_BITS = 4
#: Rows that a coarse cell should hold on average.
CELL_ROWS = 256


def quantized(value: Column, lo: float, hi: float, bits: int = BITS) -> Column:
    """Grid coordinate of ``value``; an axis without extent is 0."""
    top = (1 << bits) - 1
    if not hi > lo:
        return F.lit(0).cast("long")
    return F.floor(F.lit(float(top)) * (value.cast("double") - F.lit(float(lo))) / F.lit(float(hi) - float(lo))).cast("long")


def interleaved(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """The code of three grid coordinates."""
    parts = []
    for b in range(bits):
        for axis, c in enumerate((x, y, z)):
            parts.append(F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long")), 3 * b + axis))
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def morton3(x: Column, y: Column, z: Column, bounds: Box) -> Column:
    return interleaved(*[quantized(c, lo, hi) for c, lo, hi in zip((x, y, z), bounds.lower, bounds.upper)])


def decoded(code: Column, bits: int = BITS) -> tuple[Column, Column, Column]:
    """The grid coordinates of a code."""

    def axis(a: int) -> Column:
        return reduce(lambda p, q: p.bitwiseOR(q), [F.shiftleft(F.shiftright(code, 3 * b + a).bitwiseAND(F.lit(1).cast("long")), b) for b in range(bits)])

    return axis(0), axis(1), axis(2)


def cell(code: Column, bits: int, of: int = BITS) -> Column:
    """The prefix of a code that names its cell on a grid of ``bits`` bits an axis."""
    return F.shiftright(code, 3 * (of - bits))


def coarse_bits(counts: dict[int, int], cell_rows: int = CELL_ROWS) -> int:
    """Bits an axis for ``counts`` of rows by cell at COARSE_BITS, so that cells are full enough.

    The grid stays as it is for few rows or full cells; else it is halved until
    cells hold more than ``cell_rows`` on average, down to one bit.
    """
    n, bits, cells = sum(counts.values()), COARSE_BITS, set(counts)
    if n > cell_rows and n / len(cells) < cell_rows:
        while bits > 1 and n / len(cells) <= cell_rows:
            bits -= 1
            cells = {c >> 3 for c in cells}
    return bits


def coarse_counts(df: DataFrame, code: str = "morton") -> dict[int, int]:
    """Rows by cell at COARSE_BITS: one aggregate, whose 4,096 rows at most come to the driver."""
    rows = df.groupBy(cell(F.col(code), COARSE_BITS).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.c: r.n for r in rows}


def coarse_bits_of(df: DataFrame, code: str = "morton") -> int:
    return coarse_bits(coarse_counts(df, code))


def fullest(counts: dict[int, int], bits: int) -> int:
    """Rows of the fullest cell on a grid of ``bits`` bits, from counts at COARSE_BITS."""
    cells: dict[int, int] = {}
    for c, n in counts.items():
        c >>= 3 * (COARSE_BITS - bits)
        cells[c] = cells.get(c, 0) + n
    return max(cells.values(), default=0)
