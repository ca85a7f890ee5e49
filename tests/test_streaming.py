from pointlake.operators.table import ParticleTable
from pointlake.plans.query import QuerySpec
from pointlake.schema import ParticleSchema
from pointlake.streaming import ingest as stream


def test_snapshots_become_time_steps(spark, tmp_path):
    kind = "pid long, x double, y double, z double, a int, t int"
    for t in range(3):
        spark.createDataFrame([(i, float(i), float(t), 0.0, i, t) for i in range(10 + t)], kind).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    df = spark.read.parquet(str(tmp_path / "in"))
    schema = ParticleSchema.of(df, timestep="t")
    source = stream.snapshots(spark, str(tmp_path / "in"), df.schema)
    for _ in range(2):  # the second run finds nothing new
        stream.ingest(source, schema, str(tmp_path / "out"), str(tmp_path / "ck"), {"bytesPerSubfile": 100}).awaitTermination(120)
    table = ParticleTable.open(spark, str(tmp_path / "out"))
    assert table.num_points() == 33 and [table.query(QuerySpec(timestep=t)).count() for t in range(3)] == [10, 11, 12]
