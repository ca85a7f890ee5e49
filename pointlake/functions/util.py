"""Small values for reports and names."""

from __future__ import annotations

import re

import numpy as np


def format_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1000 or unit == "TB":
            return f"{n:.2f}{unit}" if unit != "B" else f"{int(n)}B"
        n /= 1000
    return ""


def format_count(n: float) -> str:
    for unit in ("", "K", "M", "B"):
        if n < 1000 or unit == "B":
            return f"{n:.2f}{unit}" if unit else str(int(n))
        n /= 1000
    return ""


def align_to(n: int, step: int) -> int:
    return -(-n // step) * step


def extension(path: str) -> str:
    name = basename(path)
    return name.rsplit(".", 1)[1] if "." in name else ""


def basename(path: str) -> str:
    return canonical(path).rsplit("/", 1)[-1]


def basepath(path: str) -> str:
    return canonical(path).rsplit("/", 1)[0] if "/" in canonical(path) else "."


def canonical(path: str) -> str:
    return re.sub(r"(?<![:/])//+", "/", path.replace("\\", "/"))


class Pcg32:
    """The public PCG32 generator (XSH-RR); stream 0 has the increment 1."""

    def __init__(self, seed: int = 0, stream: int = 0):
        self.state, self.inc = 0, (stream << 1 | 1) & MASK64
        self.next()
        self.state = (self.state + seed) & MASK64
        self.next()

    def next(self) -> int:
        old = self.state
        self.state = (old * 6364136223846793005 + self.inc) & MASK64
        shifted, turn = ((old >> 18) ^ old) >> 27 & MASK32, old >> 59
        return (shifted >> turn | shifted << (-turn & 31)) & MASK32

    def random(self) -> float:
        return float(np.float32(self.next() * 2.0**-32))


MASK32, MASK64 = (1 << 32) - 1, (1 << 64) - 1
