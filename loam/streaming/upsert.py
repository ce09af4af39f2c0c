"""Upserts from a stream: the keys that are known are keyed state, not a join with all that is stored.

A key's state is its least row in the batch that it came with first, and that batch's
time. A row of a key without state is created and stored; all later rows of that key,
replays and late repeats among them, change nothing. State and store move on together: a
batch that runs again has the time of its first run and writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loam import schema
from loam.operators.graph import GraphStore
from loam.storage import spool

KEYS = ["collection", "_key"]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(spark: SparkSession) -> None:
    """Keys are too many for a store in the executors' heaps; a choice that is made already stays."""
    if "HDFSBacked" in spark.conf.get(_PROVIDER, "HDFSBacked"):
        spark.conf.set(_PROVIDER, _ROCKS)


def _known_at_start(rows: DataFrame, checkpoint: str) -> DataFrame:
    """The keys that were stored before the stream first began, written once: a first batch that runs again must not find its own."""
    spark, path = rows.sparkSession, f"{checkpoint.rstrip('/')}/known-at-start"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        rows.select(*KEYS).distinct().write.mode("overwrite").parquet(path)
    # All of it comes with the first batch, and never again.
    return spark.readStream.schema("collection string, _key string").parquet(path)


def upsert_stream(rows: DataFrame, store: GraphStore, checkpoint: str, name: str = "vertices") -> StreamingQuery:
    """A query that stores the new ones among the streamed ``vertices`` or ``edges`` that are there, and ends.

    Keys that the store holds before the first batch are the initial state. Of rows of one
    key in a batch the least stays. Rows that break a constraint stop the query before
    their batch is stored. One stream, or other writer, a store, and none compacts it
    between a failure and the restart.
    """
    shape = {"vertices": schema.VERTICES, "edges": schema.EDGES}[name]
    spark = store.spark
    _stateful(spark)
    rest = [c for c in shape.fieldNames() if c not in KEYS]
    # Maps have no order and no state; their text has.
    packed = rows.select(*KEYS, F.to_json(F.struct(*rest)).alias("row"))
    # A batch's time is in the checkpoint, so that it is the same when the batch runs again.
    arriving = packed.select(*KEYS, F.struct(F.current_timestamp().alias("at"), "row").alias("first"))
    known = _known_at_start(getattr(store, name), checkpoint).select(*KEYS, F.struct(F.timestamp_seconds(F.lit(0)).alias("at"), F.lit(None).cast("string").alias("row")).alias("first"))
    seen = arriving.unionByName(known).groupBy(*KEYS).agg(F.min("first").alias("first"), F.max("first.at").alias("last"))
    inner = StructType([f for f in shape.fields if f.name in rest])

    def handle(batch: DataFrame, number: int) -> None:
        # What came with this batch first. The batch is run once: checks and writing read what it gave.
        created = batch.where("first.at = last and first.row is not null").select(*KEYS, "first.row")
        found = spool(created, "batch").withColumn("row", F.from_json("row", inner)).select(*KEYS, "row.*").select(shape.fieldNames())
        store.append(name, found, f"batch-{number}")

    return seen.writeStream.foreachBatch(handle).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
