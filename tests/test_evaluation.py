import math

import pytest

from loam.operators import evaluation

CLUSTERS = {0: "xxxxxo", 1: "xooood", 2: "xxddd"}


def rows(spark, clusters):
    return spark.createDataFrame([(c, x) for c, labels in clusters.items() for x in labels], "cluster int, label string")


def test_textbook_example(spark):
    got = evaluation.evaluate(rows(spark, CLUSTERS)).first()
    assert got["purity"] == pytest.approx(12 / 17)
    assert got["nmi"] == pytest.approx(0.3645617718571898)
    assert got["ri_ref"] == pytest.approx(0.3235294117647059)
    assert got["ri_std"] == pytest.approx(0.6764705882352942)
    assert got["f5_ref"] == pytest.approx(0.22222222222222224)
    assert got["f5_std"] == pytest.approx(0.45614035087719296)


def test_pair_counts(spark):
    got = evaluation.parts(evaluation.contingency(rows(spark, CLUSTERS))).first()
    assert (got["tp_fp"], got["tp"], got["tn_fn"], got["split"]) == (40, 20, 96, 24)


def test_measures_do_not_depend_on_cluster_names(spark):
    other = {7: "xooood", 90: "xxxxxo", -3: "xxddd"}
    a, b = (evaluation.evaluate(rows(spark, c)).first() for c in (CLUSTERS, other))
    assert a.asDict() == pytest.approx(b.asDict())


def test_undefined_measures_are_nan_in_ref_and_null_in_std(spark):
    got = evaluation.evaluate(rows(spark, {0: "x"})).first()
    assert math.isnan(got["ri_ref"]) and math.isnan(got["f5_ref"]) and math.isnan(got["nmi"])
    assert got["ri_std"] is None and got["f5_std"] is None


def test_an_empty_bucket_makes_the_nmi_nan(spark):
    from pyspark.sql import functions as F

    counts = evaluation.contingency(rows(spark, {1: "xxo", 2: "oo"}))
    full = evaluation.measures(evaluation.parts(counts.withColumn("buckets", F.lit(2)), buckets="buckets")).first()
    gap = evaluation.measures(evaluation.parts(counts.withColumn("buckets", F.lit(3)), buckets="buckets")).first()
    assert not math.isnan(full["nmi"]) and math.isnan(gap["nmi"]) and gap["purity"] == full["purity"]


def test_buckets(spark):
    got = evaluation.partition_buckets(rows(spark, {1: "x", 3: "yy"})).orderBy("bucket").collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 1), (2, 0), (3, 2)]
    none = evaluation.partition_buckets(rows(spark, {}))
    assert [tuple(r) for r in none.collect()] == [(0, 0)]
