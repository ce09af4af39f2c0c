"""Columns with the names that operators use inside, and very long texts of many distinct words."""

import random

import pytest
from pyspark.sql import functions as F

from loam.llm import audit, decontam, layout, licenses, lm, neardup, quality, toxicity, warc

TEXTS = ["The quick brown fox jumps over the lazy dog near the river bank today", "Released under the MIT License. All rights reserved.", None, "", "x " * 300]
#: Names that some operator gives to a column of its own.
NAMES = (
    "distance", "item_id", "matches", "n_matches", "label", "held_out", "evidence", "predicted", "kept", "mark", "hash", "key", "size", "target",
    "component_id", "n_shingles", "shard", "run", "mask", "bits", "digest", "position", "file", "cells", "node", "z",
)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(TEXTS * 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def operators(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    return {
        "toxicity": lambda d: toxicity.score_toxicity(d, labels), "quality": lambda d: quality.score_quality(d, labels),
        "decontamination": lambda d: decontam.contaminated(d, items), "near_duplicates": neardup.near_duplicates, "licenses": licenses.scan_licenses,
        "language_model": lm.score_texts, "audit": lambda d: audit.audit_filters(d, labels), "layout": layout.clustered_layout,
    }


@pytest.mark.parametrize("name", ["toxicity", "quality", "decontamination", "near_duplicates", "licenses", "language_model", "audit", "layout"])
def test_other_columns_do_not_matter(spark, docs, name):
    f = operators(spark)[name]
    clashing = docs.select("*", *(F.lit("x").alias(c) for c in NAMES))
    order = lambda df: sorted(map(str, df.collect()))
    assert order(f(clashing)) == order(f(docs))


def test_very_long_texts_of_many_words(spark):
    """Half a million distinct words: near copies are linked, others aren't."""
    rng = random.Random(0)
    words = [f"w{rng.getrandbits(40):x}" for _ in range(500_000)]
    near = list(words)
    for i in range(0, len(near), 50):
        near[i] = "changed"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words)))], "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in neardup.near_duplicates(docs, shingle=2).collect()}
    assert got[2][0] == 1 and got[1] == (1, 499_999) and got[3][0] == 3


def test_very_long_pages(spark):
    long = "<p>" + "é" * 3_000_000
    pages = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "u", long + "x")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == {1: (6_000_003, "response", None), 2: (6_000_003, "revisit", 1), 3: (6_000_004, "response", None)}
