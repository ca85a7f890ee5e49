"""Reports on a table and its index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.functions.bitmap import BINS


def dataset_summary(table) -> dict:
    """Name-free entry of a listing: rows and attributes with types and ranges."""
    box = table.bounds()
    return {
        "num_points": table.num_points(),
        "bounds": [list(box.lower), list(box.upper)],
        "attributes": [{"name": a, "type": table.schema.dtypes.get(a, "UNKNOWN"), "range": list(table.ranges()[a])} for a in table.attributes],
    }


def listing(spark, tables: dict) -> DataFrame:
    """One row a table: name, num_points, attributes."""
    rows = [(name, s["num_points"], [(a["name"], a["type"], *map(float, a["range"])) for a in s["attributes"]]) for name, s in ((n, dataset_summary(t)) for n, t in tables.items())]
    return spark.createDataFrame(rows, "name string, num_points long, attributes array<struct<name:string,type:string,lo:double,hi:double>>")


def bin_sizes(subfiles: DataFrame, attr: str) -> DataFrame:
    """Width of a bin by subfile if each had its own range."""
    return subfiles.select("subfile", ((F.col(f"max_{attr}") - F.col(f"min_{attr}")) / BINS).alias("bin_size"))


def treelet_sizes(nodes: DataFrame) -> DataFrame:
    return nodes.select("subfile", "cell", "n", "max_level")


def overhead(table) -> dict:
    """Bytes of rows and of the index kept for them: node rows, bitmaps (with their dictionary) and ranges."""
    n, attrs = table.num_points(), table.attributes
    base = n * table.schema.bytes_per_row()
    nodes = table.nodes().count()
    distinct = table.nodes().select(F.explode(F.array(*[F.col(f"bits_{a}") for a in attrs])).alias("b")).distinct().count() if attrs else 0
    parts = {"nodes": nodes * 12, "bitmap_ids": nodes * len(attrs) * 2, "dictionary": distinct * 4, "ranges": nodes * len(attrs) * 8}
    total = base + sum(parts.values())
    share = lambda b: 100.0 * b / base if base else 0.0
    return {
        "num_points": n, "base_bytes": base, "total_bytes": total, "treelets": nodes, "subfiles": len(table._subfiles()), "dictionary_size": distinct, **{f"{k}_bytes": v for k, v in parts.items()},
        "overhead_percent": share(total - base), "nodes_percent": share(parts["nodes"]), "bitmap_percent": share(parts["bitmap_ids"] + parts["dictionary"]), "ranges_percent": share(parts["ranges"]),
    }
