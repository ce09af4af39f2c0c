"""Incremental ingest: new files of a folder go through a family's plan and into a store, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loam.operators.graph import GraphStore
from loam.plans.families import focused


def ingest(spark: SparkSession, folder: str, family: str, store: GraphStore, checkpoint: str, **options) -> StreamingQuery:
    """A query that handles what is there and ends; upserts make a repeated batch harmless."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)

    def handle(batch: DataFrame, _: int) -> None:
        focused(family, batch.select("path", "content"), store, **options)

    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
