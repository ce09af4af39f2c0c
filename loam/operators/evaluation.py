"""Cluster quality: purity, normalised mutual information, Rand index and F-beta.

All measures follow from the contingency counts ``(cluster, label, cnt)``; nothing
larger than that is ever gathered under one key. ``ref`` measures count same-label
pairs in different clusters as agreeing pairs in the Rand index and take them from the
recall's denominator, for comparability with existing results; ``std`` measures are the
textbook ones. Undefined values are NaN in ref mode and null in std mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETA = 5
NAN = float("nan")


def contingency(rows: DataFrame, cluster: str = "cluster", label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by, F.col(cluster).alias("cluster"), F.col(label).alias("label")).agg(F.count("*").alias("cnt"))


def cluster_distribution(rows: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    return contingency(rows, cluster, label)


def label_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("cnt"))


#: Pair counts grow with the square of the rows: beyond bigint, still exact.
_EXACT = "decimal(38,0)"


def _square(x: Column) -> Column:
    return (x.cast("decimal(18,0)") * x.cast("decimal(18,0)")).cast(_EXACT)


def _choose_two(x: Column) -> Column:
    return ((_square(x) - x) / 2).cast(_EXACT)


def partition_buckets(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Sizes of all buckets 0 to the greatest label, empty ones included; no rows give one empty bucket."""
    sizes = assigned.groupBy(F.col(cluster).cast("long").alias("bucket")).agg(F.count("*").alias("size"))
    top = sizes.agg(F.coalesce(F.max("bucket"), F.lit(0)).alias("top"))
    buckets = top.select(F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("bucket"))
    return buckets.join(sizes, "bucket", "left").select("bucket", F.coalesce("size", F.lit(0)).alias("size"))


def parts(counts: DataFrame, by: tuple[str, ...] = (), buckets: str | None = None) -> DataFrame:
    """The sums that all measures rest on, one row for each value of ``by``.

    ``buckets`` names a column with the number of buckets, if empty ones are to count.
    """
    by = list(by)
    c = F.col("cnt")
    clusters = counts.groupBy(*by, "cluster").agg(
        F.sum("cnt").alias("size"), F.max("cnt").alias("top"), F.sum(_choose_two(c)).alias("tp"),
        F.sum(c * F.log2(c)).alias("clog"), F.sum(_square(c)).alias("squares"),
        *([F.max(buckets).alias("buckets")] if buckets else []),
    )
    s = F.col("size")
    over_clusters = clusters.groupBy(*by).agg(
        F.sum("size").alias("n"), F.sum("top").alias("top"), F.sum("tp").alias("tp"), F.sum(_choose_two(s)).alias("tp_fp"),
        F.sum("clog").alias("clog"), F.sum(s * F.log2(s)).alias("slog"), F.sum("squares").alias("squares"), F.sum(_square(s)).alias("size_squares"),
        F.count("*").alias("filled"), *([F.max("buckets").alias("buckets")] if buckets else []),
    )
    labels = counts.groupBy(*by, "label").agg(F.sum("cnt").alias("held"))
    h = F.col("held")
    over_labels = labels.groupBy(*by).agg(F.sum(h * F.log2(h)).alias("llog"), F.sum(_square(h)).alias("label_squares"))
    both = over_clusters.join(over_labels, by) if by else over_clusters.crossJoin(over_labels)
    n = F.col("n")
    return both.select(
        *by, "n", "top", "tp", "tp_fp",
        ((_square(n) - F.col("size_squares")) / 2).cast(_EXACT).alias("tn_fn"),
        ((F.col("label_squares") - F.col("squares")) / 2).cast(_EXACT).alias("split"),
        (F.log2(n) - F.col("llog") / n).alias("h_label"),
        (F.log2(n) - F.col("slog") / n).alias("h_cluster"),
        ((F.col("slog") - F.col("clog")) / n).alias("h_label_in_cluster"),
        (F.col("buckets") > F.col("filled") if buckets else F.lit(False)).alias("empty_bucket"),
    )


def _ratio(a: Column, b: Column, otherwise: float | None) -> Column:
    return F.when(b == 0, F.lit(otherwise).cast("double")).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def _f_beta(precision: Column, recall: Column, otherwise: float | None, beta: int) -> Column:
    square = float(beta * beta)
    below = square * precision + recall
    defined = precision.isNotNull() & recall.isNotNull() & ~F.isnan(precision) & ~F.isnan(recall)
    return F.when(defined, _ratio((square + 1) * precision * recall, below, otherwise)).otherwise(F.lit(otherwise).cast("double"))


def measures(sums: DataFrame, by: tuple[str, ...] = (), beta: int = BETA) -> DataFrame:
    """``purity, nmi, ri_ref, ri_std, f5_ref, f5_std`` from ``parts``."""
    col = F.col
    pairs = col("tp_fp") + col("tn_fn")
    nmi = _ratio(2 * (col("h_label") - col("h_label_in_cluster")), F.when(F.abs(col("h_label") + col("h_cluster")) < 1e-12, 0).otherwise(col("h_label") + col("h_cluster")), NAN)
    shaped = sums.select(
        *by, "n",
        _ratio(col("top"), col("n"), NAN).alias("purity"),
        F.when(col("empty_bucket"), F.lit(NAN)).otherwise(nmi).alias("nmi"),
        _ratio(col("tp") + col("split"), pairs, NAN).alias("ri_ref"),
        _ratio(col("tp") + col("tn_fn") - col("split"), pairs, None).alias("ri_std"),
        _ratio(col("tp"), col("tp_fp"), NAN).alias("p_ref"), _ratio(col("tp"), col("tp") + col("tn_fn") - col("split"), NAN).alias("r_ref"),
        _ratio(col("tp"), col("tp_fp"), None).alias("p_std"), _ratio(col("tp"), col("tp") + col("split"), None).alias("r_std"),
    )
    return shaped.select(
        *by, "n", "purity", "nmi", "ri_ref", "ri_std",
        _f_beta(col("p_ref"), col("r_ref"), NAN, beta).alias("f5_ref"), _f_beta(col("p_std"), col("r_std"), None, beta).alias("f5_std"),
    )


def evaluate(rows: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    return measures(parts(contingency(rows, cluster, label)))
