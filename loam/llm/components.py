"""Connected components by alternating large-star and small-star rounds.

Every round is a few shuffled aggregations and joins over the edges; nothing is
gathered on the driver but a count and a checksum. (Kiveris et al. 2014.) A count that
shows ``union.ONE_TASK`` edges at most makes one task of it, with the same results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators import union

from .shared import drop_spooled, even_join, spool


def _star(directed: DataFrame) -> DataFrame:
    """Link the ``v`` of every ``u`` to the least node near ``u``."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return even_join(directed, least, "u", by="v", wide=True)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _star(down)
    return (
        near.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(near.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Edges with a null end and self-loops are ignored. No edges give no rows.
    """
    now = spool(
        edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct(), "edges"
    )
    state = None
    if now.count() <= union.ONE_TASK:
        return union.united_edges(now)
    while True:
        large = spool(_large_star(now), "edges")
        after = spool(_small_star(large), "edges")
        drop_spooled(large)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_spooled(now)
        now = after
        if mark == state:
            break
        state = mark
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
