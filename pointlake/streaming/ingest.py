"""Snapshots as a stream: each micro-batch's rows become time steps of a table.

Work is per time step and has no state: a step that comes again replaces itself, so a
batch that is run twice after a failure leaves the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pointlake.operators.writer import ParticleWriter
from pointlake.schema import ParticleSchema


def ingest(stream: DataFrame, schema: ParticleSchema, path: str, checkpoint: str, options: dict | None = None) -> StreamingQuery:
    """Append each batch's time steps to the table at ``path`` until there is no more input."""

    def put(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        writer = ParticleWriter(batch, schema)
        for name, value in (options or {}).items():
            writer.option(name, value)
        writer.save(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshots(spark: SparkSession, folder: str, kind: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet snapshots that land in ``folder``."""
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
