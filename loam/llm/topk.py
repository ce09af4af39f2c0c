"""Exact top-k search by integer inner product with MaxScore pruning over sharded postings.

A vector's non-zero components are its terms. A shard holds, for every dimension, a
posting column of its candidates and the least and greatest value in it, from which a
query term's score bound follows. For each query, terms are sorted by bound; those
whose bounds together can't lift a candidate to the k-th best score so far are
non-essential. Essential postings are traversed and accumulated, then the other terms
are probed, from the greatest bound down, for those candidates only that are still
competitive. Shards give their k best per query, and these are merged.

Shards and query blocks are bounded packages of rows; every block of queries meets
every shard once. The first shard is searched before the others, and each query's k-th
best score there is the threshold that it begins with in all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import narrow_input, spool

#: Candidates of a shard and queries of a block, on average.
SHARD, BLOCK = 4096, 512
SCALE = 256


class Shard:
    """Postings by dimension; candidates are in the order of their ids, and an id may have several."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.columns = np.ascontiguousarray(vectors[order].T)
        self.low = np.minimum(self.columns.min(axis=1), 0)
        self.high = np.maximum(self.columns.max(axis=1), 0)
        #: Whether a candidate is the first of its id: scores of these bound the k-th best id's from below.
        self.first = np.append(True, self.ids[1:] != self.ids[:-1])

    def search(self, query: np.ndarray, own: int, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best ids but ``own``, with ties to the smaller id, and the postings that were read.

        Ids whose score is below ``floor`` may be left out.
        """
        bounds = np.maximum(query * self.low, query * self.high)
        terms = np.argsort(-bounds, kind="stable")
        terms = terms[query[terms] != 0]
        after = np.append(np.cumsum(bounds[terms][::-1])[::-1], 0)
        live = np.flatnonzero(self.ids != own)
        firsts = live[self.first[live]]
        if len(firsts) <= k:
            return *self._best(live, query @ self.columns[:, live], k), len(terms) * len(live)
        # A first threshold from a fixed handful of ids, scored in full.
        some = firsts[: 8 * k]
        threshold = max(floor, np.partition(query @ self.columns[:, some], -k)[-k])
        essential = int(np.searchsorted(-after, -threshold, side="right")) if threshold > 0 else len(terms)
        essential = min(max(essential, 1), len(terms)) if len(terms) else 0
        partial = query[terms[:essential]] @ self.columns[terms[:essential]]
        # The best so far, scored in full, lift the threshold.
        best = firsts[np.argpartition(-partial[firsts], k - 1)[:k]]
        threshold = max(threshold, (query @ self.columns[:, best]).min())
        visited = len(terms) * (len(some) + k) + essential * len(live)
        partial = partial[live]
        # Non-essential terms can still add after[t] at most.
        for t in range(essential, len(terms) + 1):
            keep = partial + after[t] >= threshold
            if not keep.all():
                live, partial = live[keep], partial[keep]
            if t == len(terms):
                break
            visited += len(live)
            partial = partial + query[terms[t]] * self.columns[terms[t], live]
        return *self._best(live, partial, k), visited

    def _best(self, live: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best ids among candidates in order, each with its best score."""
        if not len(live):
            return self.ids[live], scores
        ids = self.ids[live]
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        ids, scores = ids[starts], np.maximum.reduceat(scores, starts)
        if len(ids) > k:
            keep = scores >= np.partition(scores, -k)[-k]
            ids, scores = ids[keep], scores[keep]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


#: Sums below are exact in doubles; sums below the second bound are, and have to be, in 64-bit integers.
EXACT, MOST = 1 << 53, 1 << 63


def _scaled(vectors: np.ndarray) -> np.ndarray:
    scaled = np.floor(SCALE * np.asarray(vectors, dtype=np.float64))
    if scaled.size and np.abs(scaled).max() >= MOST:
        raise OverflowError("a scaled component doesn't fit 64 bits")
    return scaled.astype(np.int64)


def _narrow(vectors: np.ndarray) -> tuple[int, bytes]:
    """The bytes that a component needs, and the vectors so packed."""
    least, most = (int(vectors.min()), int(vectors.max())) if vectors.size else (0, 0)
    width = next(w for w in (2, 4, 8) if -(1 << (8 * w - 1)) <= least and most < 1 << (8 * w - 1))
    return width, vectors.astype(f"<i{width}").tobytes()


def _wide(raw: bytes, width: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{width}").reshape(-1, dims)


def _largest(vectors: np.ndarray) -> int:
    return max(abs(int(vectors.min())), abs(int(vectors.max())))


def _fit(most: int, queries: np.ndarray) -> type:
    """In what products of these queries with candidates up to ``most`` are exact."""
    reach = most * _largest(queries) * queries.shape[1]
    if reach >= MOST:
        raise OverflowError("an inner product may not fit 64 bits")
    return np.float64 if reach < EXACT else np.int64


def _packed(table: pa.Table) -> pa.Table:
    """Rows of one package as a row of bytes for each length of vector."""
    ids = table.column("vec_id").to_numpy()
    lists = table.column("embedding").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    flat, starts = lists.flatten().to_numpy(), np.cumsum(lengths) - lengths
    out = []
    for dims in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dims)
        vectors = _scaled(flat[starts[rows][:, None] + np.arange(dims)])
        # Repeated rows count once.
        _, keep = np.unique(np.column_stack([ids[rows], vectors]), axis=0, return_index=True)
        keep.sort()
        out.append((int(dims), ids[rows][keep].tobytes(), *_narrow(vectors[keep])))
    package = table.column("package")[0].as_py()
    return pa.table(
        {"package": pa.array([package] * len(out), pa.int64()), "dims": pa.array([o[0] for o in out], pa.int32()),
         "ids": pa.array([o[1] for o in out], pa.binary()), "width": pa.array([o[2] for o in out], pa.int32()),
         "vectors": pa.array([o[3] for o in out], pa.binary())}
    )


def _packages(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("package", F.expr(f"pmod(xxhash64(vec_id, embedding), {n})")).groupBy("package").applyInArrow(
        _packed, "package long, dims int, ids binary, width int, vectors binary"
    )


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Shard, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of queries with the shard that they meet, and their ids, vectors and thresholds; the last shard is held."""
    held: tuple[bytes, bytes, np.ndarray, dict[type, Shard]] | None = None
    for batch in batches:
        for row in batch.to_pylist():
            d = row["dims"]
            if held is None or held[:2] != (row["ids"], row["vectors"]):
                held = row["ids"], row["vectors"], _wide(row["vectors"], row["width"], d), {}
            owners, queries = np.frombuffer(row["query_ids"], np.int64), _wide(row["queries"], row["query_width"], d)
            kind = _fit(_largest(held[2]), queries)
            if kind not in held[3]:
                held[3][kind] = Shard(np.frombuffer(row["ids"], np.int64), held[2].astype(kind))
            floors = np.full(len(owners), -np.inf) if row["floors"] is None else np.frombuffer(row["floors"])
            yield row["block"], held[3][kind], owners, queries.astype(kind), floors


def _floored(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each query's k-th best score in a shard, or minus infinity where that has fewer ids."""
    for block, shard, owners, queries, _ in _meetings(batches):
        scores = [shard.search(q, o, k)[1] for o, q in zip(owners, queries, strict=True)]
        # Not above the score, where a double can't hold it.
        floors = np.array([np.nextafter(float(s[k - 1]), -np.inf) if len(s) >= k else -np.inf for s in scores])
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([queries.shape[1]], pa.int32()), pa.array([floors.tobytes()], pa.binary())], ["block", "dims", "floors"])


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for _, shard, owners, queries, floors in _meetings(batches):
        found = [shard.search(q, o, k, f)[:2] for o, q, f in zip(owners, queries, floors, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(owners, [len(f[0]) for f in found])),
                pa.array(np.concatenate([f[0] for f in found])),
                pa.array(np.concatenate([f[1] for f in found]).astype(np.int64)),
            ],
            ["query_id", "vec_id", "score"],
        )


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best candidates of every vector whose id is divisible by ``every``.

    Components become ``floor(256 * x)``; the score is their inner product, exact: in
    doubles where these hold all sums, in 64-bit integers beyond; where these may not hold
    one either, an ``OverflowError`` ends the job. A query meets every row but those with its own id.
    Vectors that are null, empty or hold null, NaN or infinite components, and rows
    without an id, take no part; vectors of different lengths don't meet; rows that
    repeat an id and vector count once, and of the scores that the vectors of one id
    give a query the best counts. Ties go to the smaller id. Other columns are ignored;
    an empty table gives no rows.
    """
    rows = (
        narrow_input(vectors, vec_id=id_col, embedding=vector_col)
        .withColumns({"vec_id": F.col("vec_id").cast("long"), "embedding": F.col("embedding").cast("array<double>")})
        .where("vec_id is not null and size(embedding) > 0")
        .where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    )
    # Vectors of one id are dealt by their components; only equal rows can fill a package.
    if not rows.groupBy("vec_id").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).isEmpty():
        rows = rows.dropDuplicates(["vec_id", "embedding"])
    asked = rows.where(F.col("vec_id") % every == 0)
    n, m = rows.count(), asked.count()
    shards, parts = max(1, -(-n // SHARD)), max(1, -(-m // BLOCK))
    candidates = spool(_packages(rows, shards), "shards")
    blocks = _packages(asked, parts).select(F.col("package").alias("block"), "dims", F.col("ids").alias("query_ids"), F.col("width").alias("query_width"), F.col("vectors").alias("queries"))
    blocks = spool(blocks, "blocks")
    columns = ["block", "dims", "ids", "width", "vectors", "query_ids", "query_width", "queries", "floors"]
    if shards > 1:
        every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("block")
        shard = candidates.where("package = 0").select(every_block, "dims", "ids", "width", "vectors")
        first = shard.join(blocks.withColumn("floors", F.lit(None).cast("binary")), ["block", "dims"]).select(columns)
        floors = first.mapInArrow(lambda it: _floored(it, k), "block long, dims int, floors binary")
        blocks = blocks.join(floors, ["block", "dims"], "left")
    else:
        blocks = blocks.withColumn("floors", F.lit(None).cast("binary"))
    everywhere = blocks.withColumn("package", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    found = (
        candidates.join(everywhere, ["package", "dims"]).select(columns)
        .mapInArrow(lambda it: _searched(it, k), "query_id long, vec_id long, score long")
        .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
