"""Points of few dimensions in tiles with halos: one pass over a tile finds its core points and links.

Tiles are cut by quantiles, dimension after dimension. A tile also gets the points within
twice eps of it: those within eps of it are then known to be core or not without asking
their own tile, and all links of the tile's own points are seen in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators import cluster, union
from loam.operators.distance import _measured
from loam.storage import spool

#: Dimensions that tiles are made for, at most.
DIMENSIONS = 3
#: Own points of a tile on average; points that it may hold, copies included; copies of a point on average, at most.
TILE, MOST, COPIES = 16_384, 65_536, 4
#: Pairs that are measured at a time, on average.
PAIRS = 1 << 20
#: Extent of the points in eps from which places in it aren't told exactly any more.
FAR = 1e12

_DEALT = "tile int, point long, own boolean, near boolean, weight long, value array<double>"
_LINKED = "point long, root long, own boolean, core boolean"


def _flat(values: pa.Array, rows: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _place(cuts: np.ndarray, branch: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which part of its branch each value falls into."""
    return (cuts[branch] <= x[:, None]).sum(axis=1)


def _moved(x: np.ndarray, by: float) -> np.ndarray:
    return np.nextafter(x + by * (1 + 1e-9), np.inf if by > 0 else -np.inf)


def _reached(v: np.ndarray, cuts: list[np.ndarray], eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows and tiles of points and their copies, which of these are the tile's own and which are within ``eps`` of it."""
    rows, tile = np.arange(len(v)), np.zeros(len(v), np.int64)
    own, near = np.ones(len(v), bool), np.ones(len(v), bool)
    for k, at in enumerate(cuts):
        x, fan = v[rows, k], at.shape[1] + 1
        first, last = _place(at, tile, _moved(x, -2 * eps)), _place(at, tile, _moved(x, 2 * eps))
        n = last - first + 1
        part = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        spread = lambda a, n=n: np.repeat(a, n)
        within = (part >= spread(_place(at, tile, _moved(x, -eps)))) & (part <= spread(_place(at, tile, _moved(x, eps))))
        own, near = spread(own) & (part == spread(_place(at, tile, x))), spread(near) & within
        rows, tile = spread(rows), spread(tile) * fan + part
    return rows, tile, own, near


def _dealt(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray], eps: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 1_000):
            batch = whole.slice(start, 1_000)
            rows, tile, own, near = _reached(_flat(batch.column("value"), batch.num_rows), cuts, eps)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tile.astype(np.int32)), batch.column("point").take(take), pa.array(own), pa.array(near), batch.column("weight").take(take), batch.column("value").take(take)],
                ["tile", "point", "own", "near", "weight", "value"],
            )


def _copies(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray], eps: float) -> Iterator[pa.RecordBatch]:
    """Points, and about how many tiles hold them: as many parts in each dimension as within their own branch."""
    for batch in batches:
        v, tile, n = _flat(batch.column("value"), batch.num_rows), np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows)
        for k, at in enumerate(cuts):
            n *= _place(at, tile, _moved(v[:, k], 2 * eps)) - _place(at, tile, _moved(v[:, k], -2 * eps)) + 1
            tile = tile * (at.shape[1] + 1) + _place(at, tile, v[:, k])
        yield pa.RecordBatch.from_arrays([pa.array([float(len(v))]), pa.array([n.sum()])], ["points", "copies"])


def _branched(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v, tile = _flat(batch.column("value"), batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for k, at in enumerate(cuts):
            tile = tile * (at.shape[1] + 1) + _place(at, tile, v[:, k])
        yield pa.RecordBatch.from_arrays([pa.array(tile.astype(np.int32)), pa.array(v[:, len(cuts)].copy())], ["branch", "x"])


def _cuts(points: DataFrame, dimensions: int, count: int) -> list[np.ndarray]:
    """For each dimension the bounds that cut each part that the former ones made: as many numbers as there are tiles."""
    fan = max(1, round((count / TILE) ** (1 / dimensions)))
    parts = [k / fan for k in range(1, fan)]
    cuts: list[np.ndarray] = []
    for k in range(dimensions):
        at = np.full((fan**k, fan - 1), np.inf)
        if parts:
            placed = points.select("value").mapInArrow(lambda it, cuts=list(cuts): _branched(it, cuts), "branch int, x double")
            for r in placed.groupBy("branch").agg(F.percentile_approx("x", parts, F.lit(10_000)).alias("at")).collect():
                at[r["branch"]] = r["at"]
        cuts.append(at)
    return cuts


def dealt(points: DataFrame, eps: float) -> DataFrame | None:
    """``(tile, point, own, near, weight, value)``; None if the points have many dimensions, or lie so that tiles don't pay."""
    first = points.select(F.size("value").alias("n")).first()
    if first is None or not 0 < first["n"] <= DIMENSIONS or not 0 < eps < np.inf:
        return None
    dimensions = first["n"]
    ends = [f(F.col("value")[k]) for k in range(dimensions) for f in (F.min, F.max)]
    count, *bounds = points.agg(F.count("*"), *ends).first()
    if any(not hi - lo <= FAR * eps for lo, hi in zip(bounds[::2], bounds[1::2], strict=True)):
        return None
    cuts = _cuts(points, dimensions, count)
    held, copies = points.select("value").mapInArrow(lambda it: _copies(it, cuts, eps), "points double, copies double").agg(F.sum("points"), F.sum("copies")).first()
    if copies > COPIES * held:
        return None
    rows = spool(points.select("point", "weight", "value").mapInArrow(lambda it: _dealt(it, cuts, eps), _DEALT), "tiles")
    largest = rows.groupBy("tile").count().agg(F.max("count")).first()[0]
    return rows if largest <= MOST else None


def near_pairs(v: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of rows at most ``eps`` apart, each in both directions and with itself, some at a time.

    Points are sorted by the bins of a grid; what may be near one lies in successive bins of the last dimension, for each place in the others.
    """
    bins = np.floor((v - v.min(axis=0)) / (1.01 * eps)).astype(np.int64) + 1
    spans = bins.max(axis=0) + 3
    rank, known = np.zeros(len(v), np.int64), []
    for k in range(v.shape[1] - 1):
        keys, rank = np.unique(rank * spans[k] + bins[:, k], return_inverse=True)
        known.append(keys)
    last = rank * spans[-1] + bins[:, -1]
    order = np.argsort(last, kind="stable")
    last = last[order]
    for steps in product((-1, 0, 1), repeat=v.shape[1] - 1):
        rank, there = np.zeros(len(v), np.int64), np.ones(len(v), bool)
        for k, step in enumerate(steps):
            key = rank * spans[k] + bins[:, k] + step
            rank = np.searchsorted(known[k], key).clip(max=len(known[k]) - 1)
            there &= known[k][rank] == key
        middle = rank * spans[-1] + bins[:, -1]
        low, high = np.searchsorted(last, middle - 1, "left"), np.searchsorted(last, middle + 1, "right")
        n = np.where(there, high - low, 0)
        total = np.cumsum(n)
        start = 0
        while start < len(v):
            end = max(start + 1, int(np.searchsorted(total, total[start] - n[start] + PAIRS, "right")))
            m = n[start:end]
            a = np.repeat(np.arange(start, end), m)
            b = order[np.repeat(low[start:end] - np.cumsum(m) + m, m) + np.arange(m.sum())]
            close = _measured(v[a], v[b], ("euclidean",))["euclidean"] <= eps
            yield a[close], b[close]
            start = end


def _linked(table: pa.Table, eps: float, min_pts: int) -> pa.Table:
    """Core points of a tile and near it with the least core point that they are linked to there, and its own border points with those beside."""
    table = table.combine_chunks().sort_by("point")
    v = _flat(table.column("value").combine_chunks(), table.num_rows)
    point, weight = table.column("point").to_numpy(), table.column("weight").to_numpy()
    own, near = (table.column(c).to_numpy() for c in ("own", "near"))
    held = np.zeros(len(v), np.int64)
    for a, b in near_pairs(v, eps):
        held += np.bincount(a, weights=weight[b], minlength=len(v)).astype(np.int64)
    # Of points beyond eps from the tile not all neighbours are here.
    core = near & (held >= min_pts)
    parent, beside = np.arange(len(v)), [np.zeros((0, 2), np.int64)]
    for a, b in near_pairs(v, eps):
        seen = core[b] & ~core[a] & own[a]
        beside.append(np.column_stack([a[seen], b[seen]]))
        both = core[a] & core[b] & (a < b)
        union.unite(parent, a[both], b[both])
    at, sides = np.flatnonzero(core), np.concatenate(beside)
    sides = np.unique(np.column_stack([sides[:, 0], parent[sides[:, 1]]]), axis=0)
    return pa.table({
        "point": np.concatenate([point[at], point[sides[:, 0]]]), "root": np.concatenate([point[parent[at]], point[sides[:, 1]]]),
        "own": np.concatenate([own[at], np.ones(len(sides), bool)]), "core": np.concatenate([np.ones(len(at), bool), np.zeros(len(sides), bool)]),
    })


def clustered(points: DataFrame, rows: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """``(value, weight, cluster, core)`` of distinct points, as by ``spatial._clustered``."""
    linked = spool(rows.groupBy("tile").applyInArrow(lambda t: _linked(t, eps, min_pts), _LINKED), "linked")
    cores = linked.where("core")
    # A core point near other tiles names its cluster there, too: what these names share is one cluster.
    copies, mine = cores.where("not own").select("point", F.col("root").alias("j")), cores.where("own").select("point", F.col("root").alias("i"))
    shared = spool(copies.join(mine, "point").where("i <> j").select("i", "j").distinct(), "shared")
    names = cores.select(F.col("root").alias("node_id")).distinct()
    roots = spool(cluster.components(names, shared.unionByName(shared.select(F.col("j").alias("i"), F.col("i").alias("j")))), "roots")
    numbers = cluster.numbered(roots.select("root").distinct(), "root")
    numbered = roots.join(numbers, "root").select(F.col("node_id").alias("root"), F.col("number").alias("cluster"))
    every = linked.where("own").join(numbered, "root").groupBy("point").agg(F.min("cluster").alias("cluster"), F.first("core").alias("core"))
    return points.join(every, "point", "left").select("value", "weight", F.coalesce("cluster", F.lit(0).cast("long")).alias("cluster"), F.coalesce("core", F.lit(False)).alias("core"))
