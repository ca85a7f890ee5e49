"""Which rows share a file: a balanced k-d division of blocks, planned on the driver.

The input is a histogram of blocks (id, lower corner, rows), bounded by the grid; the
output maps each block to a subfile. Rows are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Block:
    id: int
    corner: tuple[float, float, float]
    rows: int


@dataclass(frozen=True)
class Split:
    """An inner node of the plan: the axis and position it divides at, and its box of corners."""

    axis: int
    position: float
    lower: tuple[float, float, float]
    upper: tuple[float, float, float]


@dataclass
class Plan:
    leaves: list[list[Block]]
    splits: list[Split]

    def subfile_of(self) -> dict[int, int]:
        return {b.id: n for n, leaf in enumerate(self.leaves) for b in leaf}


def capacity(bytes_per_subfile: int, bytes_per_row: int) -> int:
    return max(1, math.ceil(bytes_per_subfile / bytes_per_row))


def extent(blocks: Sequence[Block]) -> tuple[tuple[float, ...], tuple[float, ...], list[int]]:
    full = [b for b in blocks if b.rows] or list(blocks)
    lower = tuple(min(b.corner[a] for b in full) for a in range(3))
    upper = tuple(max(b.corner[a] for b in full) for a in range(3))
    return lower, upper, sorted(range(3), key=lambda a: (lower[a] - upper[a], a))


def best_split(blocks: Sequence[Block], axes: Sequence[int]) -> tuple[float, int, float] | None:
    """(cost, axis, position) of the most even split; running totals over blocks sorted on the axis."""
    total, best = sum(b.rows for b in blocks), None
    for axis in axes:
        at: dict[float, int] = {}
        for b in blocks:
            at[b.corner[axis]] = at.get(b.corner[axis], 0) + b.rows
        left = 0
        for position in sorted(at):
            if 0 < left < total:
                cost = abs(0.5 - left / total)
                if best is None or cost < best[0]:
                    best = (cost, axis, position)
            left += at[position]
    return best


def _packed(blocks: Sequence[Block], most: int) -> list[list[Block]]:
    """Blocks that no plane divides, in order of their ids, as many together as there is room for."""
    out: list[list[Block]] = [[]]
    held = 0
    for b in sorted(blocks, key=lambda b: (b.id is None, b.id)):
        if out[-1] and b.rows and held + b.rows > most:
            out.append([])
            held = 0
        out[-1].append(b)
        held += b.rows
    return out


def adaptive(blocks: Sequence[Block], most: int, find_best_axis: bool = False, imbalance: float = 4.0, overfull: float = 1.5) -> Plan:
    """Divide until a leaf holds at most ``most`` rows; blocks are never cut.

    A leaf is also made where only one block has rows, and, if it is within
    ``overfull``, where the best split is as uneven as ``imbalance`` or a side
    would hold a single row. Blocks in one place, which no plane divides, are
    dealt to as many leaves as they fill.
    """
    plan, todo = Plan([], []), [list(blocks)]
    while todo:
        part = todo.pop()
        total = sum(b.rows for b in part)
        if total <= most or sum(b.rows > 0 for b in part) <= 1:
            plan.leaves.append(part)
            continue
        lower, upper, axes = extent(part)
        best = best_split(part, axes if find_best_axis else axes[:1]) or best_split(part, axes)
        if best is None:
            plan.leaves += _packed(part, most)
            continue
        cost, axis, position = best
        left = [b for b in part if b.corner[axis] < position]
        right = [b for b in part if b.corner[axis] >= position]
        if total <= most * overfull and (cost >= imbalance or 1 in (sum(b.rows for b in left), sum(b.rows for b in right))):
            plan.leaves.append(part)
            continue
        plan.splits.append(Split(axis, position, lower, upper))
        todo += [right, left]
    return plan


def fixed(blocks: Sequence[Block], subfiles: int) -> Plan:
    """Divide at the middle block of the longest axis until parts have ceil(blocks / subfiles) blocks."""
    most, plan, todo = math.ceil(len(blocks) / max(1, subfiles)), Plan([], []), [list(blocks)]
    while todo:
        part = todo.pop()
        if len(part) <= most:
            plan.leaves.append(part)
            continue
        lower, upper, axes = extent(part)
        part = sorted(part, key=lambda b: (b.corner[axes[0]], b.id))
        middle = len(part) // 2
        plan.splits.append(Split(axes[0], part[middle].corner[axes[0]], lower, upper))
        todo += [part[middle:], part[:middle]]
    return plan
