"""Mixing, and the pipeline against a brute-force version of its stages."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loam.llm import decontam, mixing, pii, quality
from loam.llm.textscan import PowerTable

from test_pairs_and_search import least_distance, plain_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_targets(sizes):
    """Targets by literally resharing the excess until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total = 1.5 * sum(sizes.values())
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] for s in capped} | {s: weight[s] * rest / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            return target
        capped |= set(over)


def plain_mix(rows):
    """``(position, pass, doc_id, taken)`` of every taken pass, in training order."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, held = defaultdict(int), defaultdict(list)
    for i, t, s in rows:
        sizes[s] += words(t)
        held[s].append((hashlib.md5((t or "" if i is None else str(i)).encode()).hexdigest(), i, words(t)))
    targets = plain_targets(sizes)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    out = []
    for s, docs in held.items():
        drift, want, before = (0.5, -0.5, 0.0)[order.index(s) % 3], round(targets[s]), 0
        for p in range(2):
            for _, i, n in sorted(docs, key=lambda d: (d[0], d[1] or 0, d[2])):
                if (taken := max(0, min(n, want - before))) > 0:
                    out.append((plain_inverse(before / targets[s], drift), p, i, taken))
                before += n
    return sorted(out), targets


def plain_inverse(share, drift):
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (1 - drift) * mid + drift * mid * mid < share else (lo, mid)
    return (lo + hi) / 2


ROWS = [(i, "w " * (i * 7 % 13), f"s{i * i % 5}" if i % 11 else None) for i in range(200)] + [(500, None, "s1"), (501, "", "t"), (502, "x", "zero")]


def test_mixing_equals_brute_force(spark):
    want, targets = plain_mix(ROWS)
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in ROWS], DOCS).withColumnRenamed("n_chars", "target")
    got = mixing.mix(df).collect()
    assert len(got) == len(ROWS)
    taken = defaultdict(int)
    for _, _, i, n in want:
        taken[i] += n
    by_id = {r["doc_id"]: r for r in got}
    source = {i: s for i, _, s in ROWS}
    for i, r in by_id.items():
        assert r["taken"] == taken[i] <= 2 * r["size"] and r["target"] == pytest.approx(targets[source[i]])
    places = [r["position"] for r in got if r["position"] is not None]
    assert places == sorted(places)
    assert sum(r["taken"] for r in got) == pytest.approx(1.5 * sum(r["size"] for r in got), abs=len(targets))
    order = mixing.mixed_documents(df).collect()
    assert [(r["mix_pass"], r["doc_id"], r["mix_taken"]) for r in order] == [x[1:] for x in want] or sorted(
        (r["mix_pass"], r["doc_id"], r["mix_taken"]) for r in order
    ) == sorted(x[1:] for x in want)
    assert np.allclose([r["mix_position"] for r in order], [x[0] for x in want], atol=1e-9)
    again = mixing.mixed_documents(mixing.mixed_documents(df.limit(5)))
    assert again.columns == [*df.columns, "mix_pass", "mix_taken", "mix_position"]
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_repeated_rows_are_taken_by_row(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "a", "s"), (None, "b", None)]
    got = mixing.mix(spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)).collect()
    assert len(got) == 4 and all(r["taken"] <= 2 * r["size"] for r in got)


def test_rows_without_id_spread_over_buckets(spark):
    rows = [(None, f"w{i} x", "s") for i in range(300)]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)
    got = mixing.mix(df)
    assert got.count() == 300 and got.selectExpr("sum(taken)").first()[0] == 900
    keys = df.select(mixing._order_key(df["doc_id"], df["text"]).substr(1, mixing.BUCKET_DIGITS).alias("b")).distinct().count()
    assert keys > 200


def test_very_long_text(spark):
    long = "word " * 400_000
    df = spark.createDataFrame([(1, long, "en", "a", 0), (2, "x y", "en", "a", 0), (3, "z", "en", "b", 0)], DOCS)
    assert {(r["doc_id"], r["size"]) for r in mixing.mix(df).collect()} == {(1, 400_000), (2, 2), (3, 1)}


def make_corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(3)]
    docs, labels = [], []
    for i in range(120):
        words = [word() for _ in range(rng.randint(12, 50))]
        bad = rng.random() < 0.25
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)
        if not bad and i % 17 == 0:
            text += " " + items[i % 3][1]
        if not bad and i % 9 == 0:
            text += " mail someone@example.org or 10.0.0.1"
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(not bad), 0))
    for i in range(120, 150):
        base = docs[i - 120][1].split()
        base[-1] = word()
        text = " ".join(base)
        docs.append((i, text, "en", "s1", len(text)))
    docs += [(200, None, "en", None, None), (201, "", None, "s2", 0), docs[0], docs[0]]
    return docs, labels, items


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs, labels, items = make_corpus()
    tables = {
        "documents": (docs, DOCS), "labels": (labels, "doc_id long, quality int, toxic int"), "benchmark": (items, "item_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()

    # Quality: the trained weights are taken as given, what follows from them is done again.
    model = quality.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, tables["labels"][1]), "doc_id", "text", "quality")
    evidence = quality.log_ratio(model, quality.text_statistics(pa.array([d[1] for d in docs]), PowerTable()))
    assert abs(evidence).min() > 1, "no document of the fixture is near the boundary, where the site shares decide"
    rejected = {d[0] for d, e in zip(docs, evidence, strict=True) if e < 0}
    assert rejected and rejected >= {i for i, good, _ in labels if not good}
    rows = [d for d in docs if d[0] not in rejected]
    # Near-duplicates, benchmark passages and personal data.
    components, _ = plain_components([(d[0], d[1]) for d in rows], 5)
    rows = list({d[0]: d for d, c in zip(rows, components, strict=True) if c == d[0]}.values())
    leaks = lambda t: any(least_distance(decontam.normal(x), decontam.normal(t or "")) <= decontam.budget(len(decontam.normal(x))) for _, x in items)
    rows = [d for d in rows if not leaks(d[1])]
    clean = lambda t: t and re.sub(r"10\.0\.0\.1", "<ip>", t.replace("someone@example.org", "<email>"))
    rows = [(i, clean(t), lang, s) for i, t, lang, s, _ in rows]
    want, _ = plain_mix([(i, t, s) for i, t, _, s in rows])
    texts = {i: t for i, t, _, _ in rows}
    assert sorted((r["mix_pass"], r["doc_id"], r["mix_taken"]) for r in got) == sorted(x[1:] for x in want)
    assert all(r["text"] == texts[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in got)
    assert any("<email>" in r["text"] for r in got) and [r["mix_position"] for r in got] == sorted(r["mix_position"] for r in got)
    assert pii.find_spans("<email> <ip>") == []


def test_quality_goes_by_row(spark, tmp_path):
    """A rejected row takes no other row of its id along; rows without an id are judged too."""
    docs, labels, _ = make_corpus()
    bad = next(d for d in docs if d[1] and d[1].isupper())
    good = next(d for d in docs if d[1] and not d[1].isupper())
    docs += [(good[0], bad[1], "en", "s1", 0), (None, bad[1], "en", None, 0), (None, good[1], "en", None, 0)]
    frame = spark.createDataFrame(docs, DOCS).withColumn("mark", F.lit(1)).withColumn("evidence", F.lit(2))
    kept = quality.drop_low_quality(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == frame.columns
    rows = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert (good[0], good[1]) in rows and (None, good[1]) in rows
    assert not any(t == bad[1] for _, t in rows)


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    docs, labels, items = make_corpus()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ("component", "kept", "_id", "mark", "_mark", "root", "n", "digest", "size", "bucket", "key", "position", "evidence", "host", "node", "value", "a.b")
    frame = spark.createDataFrame(docs[:60], DOCS)
    for k, name in enumerate(names):
        frame = frame.withColumn(name, F.lit(k))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, f"file://{tmp_path}")
        assert out.count() > 0 and out.columns[: len(frame.columns)] == frame.columns
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == frame.columns
        assert out.select(*[f"`{c}`" for c in names]).distinct().count() == 1


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.count() == 0
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
