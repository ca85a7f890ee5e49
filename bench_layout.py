
import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from pointlake.catalog import events  # noqa: E402
from pointlake.functions.geometry import Box  # noqa: E402
from pointlake.operators.table import ParticleTable  # noqa: E402
from pointlake.operators.writer import ParticleWriter  # noqa: E402
from pointlake.plans.query import QuerySpec  # noqa: E402
from pointlake.schema import ParticleSchema  # noqa: E402


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    df = events(spark, sf_dir).drop("day")
    schema = ParticleSchema.of(df, attrs=("value",))
    out: dict = {}
    with tempfile.TemporaryDirectory() as folder:
        report = ParticleWriter(df, schema).option("bytesPerSubfile", 1 << 17).save(f"{folder}/t")
        out["write"] = json.loads(report.to_json())
        table = ParticleTable.open(spark, f"{folder}/t")
        b, (lo, hi) = table.bounds(), table.ranges()["value"]

        def timed(name: str, spec: QuerySpec) -> None:
            runs = []
            for _ in range(6):
                start = time.perf_counter()
                table.query(spec).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - start)
            stats = table.query_stats(spec) if spec.quality == 1 and not spec.prev_quality else {}
            out[name] = {"s": round(statistics.median(runs[1:]), 4), **{k: stats[k] for k in ("subfiles_kept", "rows_tested", "rows_returned") if k in stats}}

        def box(share: float) -> Box:
            side = share ** (1 / 3)
            return Box(b.lower, tuple(l + side * (u - l) for l, u in zip(b.lower, b.upper)))

        for share in (0.01, 0.1, 1.0):
            timed(f"box {share:g}", QuerySpec(box(share)))
        ranges = {"value": [(lo, lo + 0.02 * (hi - lo)), (hi - 0.5 * (hi - lo), hi)]}
        timed("box 0.1 + two ranges", QuerySpec(box(0.1), ranges))
        for a, q in zip((0, 0.1, 0.25, 0.5, 0.75), (0.1, 0.25, 0.5, 0.75, 1.0)):
            timed(f"progressive {a:g} to {q:g}", QuerySpec(prev_quality=a, quality=q))
        for name, prune in (("none", ()), ("range", ("range",)), ("bitmap", ("bitmap",)), ("both", ("range", "bitmap"))):
            timed(f"prune {name}", QuerySpec(None, {"value": [(hi - 0.05 * (hi - lo), hi)]}, prune=frozenset(prune)))
        r = table.report()
        out["overhead_percent"] = {k: round(r[f"{k}_percent"], 3) for k in ("overhead", "nodes", "bitmap", "ranges")}
        out["subfiles"] = r["subfiles"]
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
