"""Command line: ``python -m pointlake COMMAND``; each prints JSON.

    convert SOURCE TARGET         files of any known format to a written table
    generate KIND ROWS TARGET     a synthetic table (uniform, linear, exponential, spheres, cut_box)
    inspect TABLE                 its size, attributes and index
    query TABLE                   times and pruning of a request, at one or several qualities
    bitmap LO HI FROM TO          the bins of a value range that a query range can have values in
"""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import SparkSession

from pointlake.functions import bitmap
from pointlake.functions.geometry import Box
from pointlake.operators import generators, metadata
from pointlake.operators.convert import convert
from pointlake.operators.table import ParticleSession, ParticleTable
from pointlake.operators.writer import ParticleWriter
from pointlake.plans.query import QuerySpec

UNIT = Box((0.0, 0.0, 0.0), (1.0, 1.0, 1.0))
KINDS = {
    "uniform": lambda spark, n, seed: generators.uniform(spark, n, UNIT, seed),
    "linear": lambda spark, n, seed: generators.linear_gradient(spark, n, UNIT, seed),
    "exponential": lambda spark, n, seed: generators.exponential_gradient(spark, n, UNIT, seed),
    "spheres": lambda spark, n, seed: generators.spheres(spark, n, 5, UNIT, seed),
    "cut_box": lambda spark, n, seed: generators.cut_box(spark, n, UNIT, (0.5, 0.5, 0.5), seed),
}


def parsed(args: Sequence[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="pointlake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("convert")
    one.add_argument("source")
    one.add_argument("target")
    two = commands.add_parser("generate")
    two.add_argument("kind", choices=KINDS)
    two.add_argument("rows", type=int)
    two.add_argument("target")
    two.add_argument("--attributes", type=int, default=0, help="normally distributed attributes beside the positions")
    two.add_argument("--seed", type=int, default=0)
    for p in (one, two):
        p.add_argument("--option", action="append", default=[], metavar="NAME=VALUE", help="an option of the writer, such as bytesPerSubfile=1000000")
    commands.add_parser("inspect").add_argument("table")
    ask = commands.add_parser("query")
    ask.add_argument("table")
    ask.add_argument("--json", default="{}", help='{"attributes": [{"name", "range": [[lo, hi]]}], "bounds": [[lo], [hi]]}')
    ask.add_argument("--file", help="a file with such a request")
    ask.add_argument("--quality", type=float, action="append", help="may be given again: qualities are asked for in order, each adding to the one before")
    ask.add_argument("--disable-range", action="store_true")
    ask.add_argument("--disable-bitmap", action="store_true")
    ask.add_argument("-n", type=int, default=1, help="runs")
    bits = commands.add_parser("bitmap")
    for name in ("lo", "hi", "start", "end"):
        bits.add_argument(name, type=float)
    return top.parse_args(args)


def options(pairs: Sequence[str]) -> dict:
    return {k: json.loads(v) for k, v in (p.split("=", 1) for p in pairs)}


def asked(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Every run of every quality: milliseconds and rows; and what pruning does for the whole request."""
    table = ParticleTable.open(spark, a.table)
    text = spark.read.text(a.file, wholetext=True).first().value if a.file else a.json
    prune = {"range": not a.disable_range, "bitmap": not a.disable_bitmap}
    spec = replace(QuerySpec.from_json(text), prune=frozenset(k for k, on in prune.items() if on))
    runs = []
    for _ in range(a.n):
        session = ParticleSession(table)
        for quality in a.quality or [1.0]:
            start = time.perf_counter()
            rows = session.refine(replace(spec, quality=quality)).count()
            runs.append({"quality": quality, "rows": rows, "ms": round((time.perf_counter() - start) * 1e3, 1)})
    return {"runs": runs, "pruning": table.query_stats(spec)}


def answer(spark: SparkSession | None, a: argparse.Namespace) -> dict:
    if a.command == "bitmap":
        bits = bitmap.mask((a.start, a.end), (a.lo, a.hi))
        return {"mask": f"0x{bits:08x}", "bins": [i for i in range(bitmap.BINS) if bits >> i & 1], "width": bitmap.bin_width(a.lo, a.hi)}
    if a.command == "convert":
        return json.loads(convert(spark, a.source, a.target, options(a.option)).to_json())
    if a.command == "generate":
        df = KINDS[a.kind](spark, a.rows, a.seed)
        writer = ParticleWriter(generators.with_attributes(df, "normal", a.attributes) if a.attributes else df)
        for name, value in options(a.option).items():
            writer.option(name, value)
        return json.loads(writer.save(a.target).to_json())
    if a.command == "inspect":
        table = ParticleTable.open(spark, a.table)
        return metadata.dataset_summary(table) | {"index": table.report()}
    return asked(spark, a)


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parsed(args)
    if a.command != "bitmap":
        spark = spark or SparkSession.builder.appName("pointlake").getOrCreate()
    print(json.dumps(answer(spark, a)))


if __name__ == "__main__":
    main()
