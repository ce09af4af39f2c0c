"""Content by chunks: boundaries from the content itself, each chunk stored once by its digest, a recipe for each sample.

A boundary lies where a rolling hash of the last bytes has zeros in the right places, so
that an insertion moves the boundaries beside it only, and samples that share a passage
share its chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.similar import dealt_join
from loam.storage import spool

#: Bytes that decide on a boundary, and the least, usual and greatest sizes of a chunk.
WINDOW, LEAST, USUAL, MOST = 32, 128, 512, 8_192
#: Weight of the byte so many places back.
_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)
#: Bytes that are hashed at a time.
_STEP = 1 << 20


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks, the last one being the length; none for no bytes."""
    x, ends, start = np.frombuffer(data, np.uint8), [], 0
    if not len(x):
        return []
    for at in range(0, len(x), _STEP):
        # The hash after each byte of the step, from the bytes before it too.
        part = x[max(0, at - WINDOW + 1) : at + _STEP].astype(np.uint64) + np.uint64(1)
        h = np.zeros(len(part), np.uint64)
        for back in range(min(WINDOW, len(part))):
            h[back:] += part[: len(part) - back] * _WEIGHTS[back]
        h = h[len(part) - len(x[at : at + _STEP]) :]
        for place in (np.flatnonzero((h >> np.uint64(40)) % np.uint64(USUAL) == 0) + at + 1).tolist():
            while place - start > MOST:
                start += MOST
                ends.append(start)
            if place - start >= LEAST:
                ends.append(place)
                start = place
    while len(x) - start > MOST:
        start += MOST
        ends.append(start)
    return ends if ends and ends[-1] == len(x) else [*ends, len(x)]


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "place", "digest", "size", "chunk"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = content.as_py() or b""
            ends = boundaries(data)
            pieces = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)] or [b""]
            columns = [[name] * len(pieces), list(range(len(pieces))), [hashlib.sha256(p).digest() for p in pieces], [len(p) for p in pieces], pieces]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def chunked(samples: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """``(id, place, digest, size, chunk)`` of binary contents; a null or empty content is one empty chunk."""
    return samples.select(F.col(id_col).cast("long"), F.col(content_col).cast("binary")).mapInArrow(_chunked, "id long, place int, digest binary, size int, chunk binary")


def _stored(spark: SparkSession, folder: str, name: str, shape: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(f"{folder}/{name}")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark, folder, "chunks", "digest binary, chunk binary")


def recipes(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark, folder, "recipes", "id long, place int, digest binary, size int")


def add(samples: DataFrame, folder: str, id_col: str = "id", content_col: str = "content") -> None:
    """Store contents below ``folder``. Ids that have a recipe are left as they are, chunks that are there aren't written again.

    Chunks are complete before the recipes that need them, so a failed call can be made again.
    Ids are unique in a call and not null; one writer at a time.
    """
    spark = samples.sparkSession
    fresh = samples.join(recipes(spark, folder).where("place = 0").select(F.col("id").alias(id_col)), id_col, "left_anti")
    cut = spool(chunked(fresh, id_col, content_col), "chunked")
    # Digests first: a chunk that very many samples share is one row of its task before anything is moved.
    new = cut.groupBy("digest").agg(F.min("chunk").alias("chunk")).join(chunks(spark, folder).select("digest"), "digest", "left_anti")
    new.write.mode("append").parquet(f"{folder}/chunks")
    cut.drop("chunk").write.mode("append").parquet(f"{folder}/recipes")


def rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, content)`` of all that is stored. Rows of a chunk that very many samples share are dealt over tasks."""
    parts = recipes(spark, folder)
    figures = parts.groupBy("digest").agg(F.count("*").alias("n")).join(chunks(spark, folder), "digest")
    whole = dealt_join(parts, figures, "digest", "id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "chunk"))).alias("parts"))
    return whole.select("id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["chunk"])).alias("content"))


def sharing(spark: SparkSession, folder: str) -> DataFrame:
    """One row: samples, chunks in recipes and stored, chunks that several samples share, bytes in all and stored."""
    parts = recipes(spark, folder)
    by_chunk = parts.groupBy("digest").agg(F.count_distinct("id").alias("samples"), F.count("*").alias("uses"), F.max("size").cast("long").alias("size"))
    return by_chunk.agg(
        F.sum("uses").alias("uses"), F.count("*").alias("chunks"), F.count(F.when(F.col("samples") > 1, 1)).alias("shared"),
        F.sum(F.col("uses") * F.col("size")).alias("bytes"), F.sum("size").alias("stored_bytes"),
    ).crossJoin(parts.agg(F.count_distinct("id").alias("samples")))
