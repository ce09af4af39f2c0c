"""Clustering of samples without a known family: hashes, distances, a DBSCAN grid, measures, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.distance import features, fuzzy_pairs
from loam.operators.graph import GraphStore, edge_key, vertex_id
from loam.operators.sweep import dbscan_grid
from loam.sources.files import write_sweep_csv
from loam.storage import spool

DISTANCES = ("combined", "ssdeep", "third", "tlsh")
EPS = range(1, 100)
MIN_PTS = range(2, 100)


def sample_features(files: DataFrame, on_error: str = "skip") -> DataFrame:
    """Features of labelled files ``(path, content, label)``, numbered in the order of (label, path).

    A sample that one of the hashes can't take is left out, stays with that hash null with
    ``on_error='keep'``, or stops the run with ``on_error='fail'``.
    """
    labelled = files.where("label is not null").select("label", "path")
    # Numbers within a label on top of the labels before it, so that only the labels pass through one task.
    before = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    starts = labelled.groupBy("label").agg(F.count("*").alias("n")).select("label", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("label").orderBy("path"))
    ranks = labelled.withColumn("place", within).join(starts, "label").select("label", "path", (F.col("start") + F.col("place") - 1).cast("long").alias("node_id"))
    numbered = files.join(ranks, ["label", "path"]).withColumnRenamed("label", "family")
    hashed = spool(features(numbered).join(numbered.select("node_id", "path", F.sha2("content", 256).alias("sha256sum")), "node_id"), "features")
    if on_error == "keep":
        return hashed
    short = hashed.where("ssdeep is null or tlsh is null or third is null")
    if on_error == "fail" and (bad := short.orderBy("node_id").first()) is not None:
        raise ValueError(f"can't hash {bad['path']}")
    return hashed.where("ssdeep is not null and tlsh is not null and third is not null")


def general(
    files: DataFrame, csv_folder: str | None = None, store: GraphStore | None = None, distances: tuple[str, ...] = DISTANCES,
    eps: range = EPS, min_pts: range = MIN_PTS, rows_as_points: bool = True, on_error: str = "skip",
) -> DataFrame:
    """The sweep over all distances and the grid; optionally as CSV, and with samples and distances in a store.

    ``rows_as_points`` clusters the rows of the distance matrix as points instead of using
    the distances themselves.
    """
    hashed = sample_features(files, on_error)
    pairs = spool(fuzzy_pairs(hashed), "pairs")
    sweep = spool(dbscan_grid(files.sparkSession, pairs, hashed.select("node_id", "family"), list(distances), list(eps), list(min_pts), rows_as_points), "sweep")
    if csv_folder is not None:
        write_sweep_csv(sweep, csv_folder)
    if store is not None:
        store.init("GeneralCorpus")
        samples = hashed.select(F.lit("MalwareSample").alias("collection"), F.col("sha256sum").alias("_key"), F.create_map(F.lit("ssdeep"), "ssdeep").alias("attrs"))
        ids = hashed.select("node_id", vertex_id(F.lit("MalwareSample"), F.col("sha256sum")).alias("id"))
        linked = pairs.join(ids.select(F.col("node_id").alias("i"), F.col("id").alias("a")), "i").join(ids.select(F.col("node_id").alias("j"), F.col("id").alias("b")), "j")
        measured = linked.select(
            F.lit("SampleDistance").alias("collection"), edge_key("a", "b").alias("_key"), F.col("a").alias("_from"), F.col("b").alias("_to"),
            F.round("ssdeep").cast("long").alias("ssdeep_distance"),
        )
        store.upsert(samples, measured)
    return sweep
