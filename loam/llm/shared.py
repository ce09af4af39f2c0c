"""What the operators of this subpackage share: tables, spooling, size-checked joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from loam.storage import fresh_path, shared_dir

__all__ = ["BROADCAST_ROWS", "WORD", "drop_spooled", "even_join", "fresh_path", "map_rows", "narrow_input", "scratch", "shared_dir", "small", "small_batches", "spool", "table", "word_count"]

#: A side of at most this many (id) rows may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

#: Rows of one key that a task may get in a shuffled join.
HOT = 1_024

#: Rows of an Arrow batch that a Python worker gets at a time.
BATCH_ROWS = 1_000

#: One word, as all word-based operators here define it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables written since the innermost ``scratch`` began.
_written: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: computed once, and safe when executors are lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._spooled = path
    if (written := _written.get()) is not None:
        written.append(out)
    return out


def drop_spooled(*frames: DataFrame) -> None:
    """Delete spooled tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._spooled)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables spooled inside are deleted at the end, but for those given to the function that this yields.

    Kept ones pass to the scratch around, if there is one.
    """
    written, kept = [], []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    outer = _written.get()
    token = _written.set(written)
    try:
        yield keep
    finally:
        _written.reset(token)
        drop_spooled(*(df for df in written if not any(df is k for k in kept)))
        if outer is not None:
            outer.extend(kept)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def even_join(rows: DataFrame, figures: DataFrame, key: str, by: str, how: str = "inner", wide: bool = False, limit: int | None = None) -> DataFrame:
    """``rows`` with the figures of their ``key``, without a task that gets all rows of a frequent key.

    ``figures`` has a row or a few for each key. It is broadcast if a count shows that it is
    small (``limit`` rows, ``BROADCAST_ROWS`` by default), unless its rows are ``wide``. Otherwise the join shuffles, and a key of more than
    ``HOT`` rows is dealt over pieces by a hash of the column ``by``; its figures go to each.
    """
    limit = BROADCAST_ROWS if limit is None else limit
    if not wide and figures.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(figures), key, how)
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count("*") / HOT).alias("_pieces")).where("_pieces > 1")
    if hot.isEmpty():
        return rows.join(figures, key, how)
    hot = spool(hot, "hot")
    hot = small(hot)
    dealt = rows.join(hot, key, "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(by), "_pieces"), F.lit(0))).drop("_pieces")
    copied = figures.join(hot, key, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return dealt.join(copied, [key, "_piece"], how).drop("_piece")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch in this session; Spark's own ``maxBytesPerBatch`` bounds its bytes.

    With whole texts, the default of 10,000 rows fills a worker's memory.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_rows(docs: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *extra: StructField) -> DataFrame:
    """``docs`` through ``f``, which keeps all columns and may add some; ``mapInArrow`` by itself fails on names with dots."""
    small_batches(docs.sparkSession)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(f, StructType([*plain.schema.fields, *extra])).toDF(*docs.columns, *(x.name for x in extra))


def narrow_input(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under fixed names, so that other columns can't clash."""
    small_batches(docs.sparkSession)
    return docs.select(*(docs[f"`{source}`"].alias(name) for name, source in columns.items()))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
