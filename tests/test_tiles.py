"""DBSCAN of points of few dimensions by tiles against direct search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.operators import distance, spatial, tiles
from test_fuzzy_and_cluster import direct


def points_of(dimensions):
    rng = np.random.default_rng(dimensions)
    return np.concatenate([rng.normal(size=(150, dimensions)), rng.normal(scale=0.05, size=(40, dimensions)) + 3, np.full((30, dimensions), 0.5), np.full((1, dimensions), -9.0)]).round(2) + 0.0


@pytest.mark.parametrize("tile, pairs", [(12, 50), (60, 1 << 20), (0, 1 << 20)])
@pytest.mark.parametrize("dimensions, eps, min_pts", [(1, 0.02, 4), (2, 0.2, 4), (2, 0.1, 2), (3, 0.4, 3), (2, 2.0, 20)])
def test_tiles_equal_direct_search(spark, monkeypatch, dimensions, eps, min_pts, tile, pairs):
    """Several tiles, one, and none at all: then cells find the same."""
    monkeypatch.setattr(tiles, "TILE", tile)
    monkeypatch.setattr(tiles, "PAIRS", pairs)
    monkeypatch.setattr(tiles, "COPIES", 100)
    monkeypatch.setattr(spatial, "CELL", 40)
    if not tile:
        monkeypatch.setattr(tiles, "DIMENSIONS", 0)
    x = points_of(dimensions)
    m = distance._measured(x[:, None], x[None], ("euclidean",))["euclidean"]
    df = spark.createDataFrame([(3 * i - 70, [float(a) for a in v]) for i, v in enumerate(x)], "node_id long, value array<double>").repartition(3)
    got = spatial.dbscan_points(df, eps, min_pts).orderBy("node_id").collect()
    assert [r["cluster"] for r in got] == direct(m, eps, min_pts).tolist()
    assert [r["core"] for r in got] == ((m <= eps).sum(axis=1) >= min_pts).tolist()
    if tile == 12:
        dealt = tiles.dealt(df.groupBy("value").agg(F.min("node_id").alias("point"), F.count("*").alias("weight")), eps)
        assert dealt.select("tile").distinct().count() > 4 and dealt.where("own").count() == len(np.unique(x, axis=0))


def test_close_pairs_are_found_without_all_others(monkeypatch):
    asked, measured = [], tiles._measured
    monkeypatch.setattr(tiles, "_measured", lambda x, y, names: asked.append(len(x)) or measured(x, y, names))
    x = np.random.default_rng(0).uniform(0, 100, (3_000, 2))
    found = {p for a, b in tiles.near_pairs(x, 2.0) for p in zip(a.tolist(), b.tolist(), strict=True)}
    close = distance._measured(x[:, None], x[None], ("euclidean",))["euclidean"] <= 2.0
    assert found == set(zip(*(k.tolist() for k in np.nonzero(close)), strict=True))
    assert sum(asked) < 3_000 * 20


def test_points_that_tiles_do_not_suit(spark):
    shape = "point long, weight long, value array<double>"
    assert tiles.dealt(spark.createDataFrame([(1, 1, [0.0] * 4)], shape), 1.0) is None
    assert tiles.dealt(spark.createDataFrame([(1, 1, [0.0]), (2, 1, [float("inf")])], shape), 1.0) is None
    assert tiles.dealt(spark.createDataFrame([(1, 1, [0.0])], shape), 0.0) is None
    assert tiles.dealt(spark.createDataFrame([], shape), 1.0) is None
