"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line, seconds per query (median of three after a warm-up)."""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from pointlake import queries  # noqa: E402

HEADLINE = ["box_query", "attr_multi_column", "projection", "row_callback", "bounds", "attribute_ranges", "bitmap_node_or", "morton_code", "cell_ranges", "lod_assign", "progressive_delta", "progressive_series", "distance_to_box", "subfile_balance", "kd_treelets"]
#: The same over a written table, which the warm-up writes; not part of the sum, so that it stays comparable.
WRITTEN = ["layout_box", "layout_attributes", "layout_pruning", "layout_progressive", "layout_metadata"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in [*HEADLINE, *WRITTEN]:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "headline particle queries, sum of medians", "value": round(sum(took[n] for n in HEADLINE), 4), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
