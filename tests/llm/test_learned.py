"""Toxicity and quality: held-out accuracy and edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import quality, toxicity

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, score string"
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(spark, n=400, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdl") for _ in range(rng.randint(2, 8)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 60))]
        toxic, bad = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            words[5] = words[10] = "vileword"
        if bad:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "en", f"s{i % 3}", "x"))
        labels.append((i, int(not bad), int(toxic), "x"))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


def test_toxicity_holds_out_and_learns(spark):
    docs, labels = corpus(spark)
    got = toxicity.score_toxicity(docs, labels)
    held = got.where("held_out").join(labels, "doc_id").select("predicted", "toxic", "score").collect()
    assert 40 < len(held) < 140 and all(0 <= r["score"] <= 1 for r in held)
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.9 * len(held)
    folds = got.select("held_out", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("want"))
    assert folds.where("held_out <> want").count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = corpus(spark, 120)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score_toxicity(docs, x).orderBy("doc_id").select("score").collect() for x in (labels, other))
    assert a == b


def test_grams():
    assert len(toxicity.grams("")) == 0 and len(toxicity.grams("a")) == 1
    assert sorted(toxicity.grams("HeLLo").tolist()) == sorted(toxicity.grams("hello").tolist())
    assert len(toxicity.grams("hello")) == sum(7 - n + 1 for n in toxicity.GRAMS)


def plain_fit(texts, labels, rounds=60):
    """The classifier once more, gram by gram in plain Python, with gram buckets as they are."""
    grams = [Counter(toxicity.grams(t).tolist()) for t in texts]
    size = [labels.count(0), labels.count(1)]
    total, seen = [Counter(), Counter()], [Counter(), Counter()]
    for g, y in zip(grams, labels, strict=True):
        total[y].update(g)
        seen[y].update(g.keys())
    n, ratio = len(texts), {}
    prior = [toxicity.SMOOTHING * 2 * x / n for x in size]
    for b in {*seen[0], *seen[1]}:
        p = (seen[0][b] + seen[1][b]) / n
        error = math.sqrt(max(p * (1 - p), 1e-9) * (1 / size[0] + 1 / size[1]))
        if abs(seen[1][b] / size[1] - seen[0][b] / size[0]) >= toxicity.SIGNIFICANT * error:
            share = [math.log((total[y][b] + prior[y]) / (size[y] + prior[y])) for y in (0, 1)]
            ratio[b] = share[1] - share[0]
    rows = [{b: ratio[b] * c / math.sqrt(max(sum(g.values()), 1)) for b, c in g.items() if b in ratio} for g in grams]
    w, bias = dict.fromkeys(ratio, 0.0), 0.0
    m, v, mb, vb = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 0.0), 0.0, 0.0
    for t in range(1, rounds + 1):
        miss = [(1 / (1 + math.exp(-(sum(w[b] * x for b, x in r.items()) + bias))) - y) * 0.5 / size[y] for r, y in zip(rows, labels, strict=True)]
        rate = 0.1 * math.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        g = dict.fromkeys(ratio, 0.0)
        for e, r in zip(miss, rows, strict=True):
            for b, x in r.items():
                g[b] += e * x
        for b in w:
            m[b], v[b] = 0.9 * m[b] + 0.1 * g[b], 0.99 * v[b] + 0.01 * g[b] ** 2
            w[b] -= rate * m[b] / (math.sqrt(v[b]) + 1e-8)
        mb, vb = 0.9 * mb + 0.1 * sum(miss), 0.99 * vb + 0.01 * sum(miss) ** 2
        bias -= rate * mb / (math.sqrt(vb) + 1e-12)
    return {b: w[b] * ratio[b] for b in w}, bias


def test_toxicity_equals_a_plain_version(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "su") for b in ("na", "re", "to")]
    texts, labels = [], []
    for i in range(120):
        bad = i % 3 == 0
        texts.append(" ".join([rng.choice(words) for _ in range(rng.randint(2, 9))] + ["vile"] * (bad and i % 9 > 0)))
        labels.append(int(bad))
    want, bias = plain_fit(texts, labels)
    weights, got = toxicity.fit(texts, np.array(labels))
    assert len(want) > 20 and got == pytest.approx(bias, abs=1e-6)
    assert np.flatnonzero(weights).tolist() == sorted(b for b, x in want.items() if x)
    assert np.allclose([weights[b] for b in sorted(want)], [want[b] for b in sorted(want)], atol=1e-5)
    # The scores of the query follow from these weights.
    docs = spark.createDataFrame([(5 * i + 1, t, "en", "s", "x") for i, t in enumerate(texts)], DOCS)
    marks = spark.createDataFrame([(5 * i + 1, 0, y, "") for i, y in enumerate(labels)], LABELS)
    learned = [i for i in range(len(texts)) if zlib.crc32(str(5 * i + 1).encode()) % 5]
    want, bias = plain_fit([texts[i] for i in learned], [labels[i] for i in learned])
    for r in toxicity.score_toxicity(docs, marks).collect():
        g = toxicity.grams(texts[r["doc_id"] // 5])
        z = bias + sum(want.get(b, 0.0) for b in g.tolist()) / math.sqrt(max(len(g), 1))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_very_long_texts(spark):
    docs, labels = corpus(spark, 120)
    long = spark.createDataFrame([(9001, "plain words " * 60_000, "en", "s0", "x"), (9002, "x" * 500_000, "en", "s0", "x")], DOCS)
    for f in (toxicity.score_toxicity, quality.score_quality):
        rows = f(docs.unionByName(long), labels).where("doc_id > 9000").collect()
        assert len(rows) == 2 and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("labelled", [True, False])
def test_edge_cases(spark, labelled):
    docs = spark.createDataFrame([(1, None, "en", None, "x"), (2, "", None, "s", "x"), (3, "a b", "en", "s", "x"), (3, "a b", "en", "s", "x"), (None, "q", "en", "s", "x")], DOCS)
    labels = spark.createDataFrame([(1, 1, 0, ""), (2, 0, 1, ""), (3, None, None, ""), (None, 1, 1, ""), (3, 7, 7, "")] if labelled else [], LABELS)
    for f in (toxicity.score_toxicity, quality.score_quality):
        rows = f(docs, labels).collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
        assert f(docs.limit(0), labels).count() == 0


def test_quality_learns_and_shrinks(spark):
    docs, labels = corpus(spark)
    got = quality.score_quality(docs, labels).cache()
    checked = got.join(labels, "doc_id").select("kept", "quality").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in checked) >= 0.97 * len(checked)
    shares = [r[0] for r in got.select("site_share").distinct().collect()]
    assert all(0.5 < s < 0.9 for s in shares)


def test_empirical_bayes_by_hand(spark):
    """Shares with a fixed model: the formulas once more, in plain Python."""
    docs, labels = corpus(spark, 90)
    rows = quality.score_quality(docs, labels).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    model = quality.train(docs, labels, "doc_id", "text", "quality")
    prior = np.log(model["share"] / (1 - model["share"]))
    p = 1 / (1 + np.exp(-(rows["evidence"] + prior)))
    g = p.mean()
    by = p.groupby(rows["source"]).agg(["sum", "count"])
    share = by["sum"] / by["count"]

    def strength():
        n = by["count"].sum()
        mean = (share * by["count"]).sum() / n
        spread = (share**2 * by["count"]).sum() / n - mean**2
        s = mean * (1 - mean) / max(spread - mean * (1 - mean) * len(by) / n, 1e-9)
        return min(max(s, quality.LEAST_STRENGTH), quality.MOST_STRENGTH)

    k = strength()
    host = (by["sum"] + k * g) / (by["count"] + k)
    assert np.allclose(rows["source"].map(host), rows["host_share"])
    site = (by["sum"] + k * host) / (by["count"] + k)
    assert np.allclose(rows["source"].map(site), rows["site_share"])
    z = rows["evidence"] + np.log(rows["site_share"] / (1 - rows["site_share"]))
    assert np.allclose(1 / (1 + np.exp(-z)), rows["score"])


def test_held_out_accuracy_on_the_driver_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    toxic = toxicity.score_toxicity(docs, labels).where("held_out").join(labels, "doc_id")
    wrong = toxic.where("predicted <> toxic").count()
    assert wrong <= 0.02 * toxic.count()
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    kept = quality.score_quality(docs, labels.where(~held)).join(labels.where(held), "doc_id")
    assert kept.count() > 100 and kept.where("kept <> (quality = 1)").count() <= 0.02 * kept.count()


@pytest.mark.parametrize("hot", [4, 1_024])
def test_sites_beyond_the_limit_are_joined_alike(spark, monkeypatch, hot):
    """With no broadcast and a hot site whose rows are dealt, every row has the figures of its own site."""
    from loam.llm import shared

    docs, labels = corpus(spark, 200)
    # Sites with nulls and with the text of a null; one has most rows.
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise("null"))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise("en"))
    docs = docs.unionByName(docs.where("doc_id < 3"))
    want = sorted(map(tuple, quality.score_quality(docs, labels).collect()))
    monkeypatch.setattr(quality, "SITES", 0)
    monkeypatch.setattr(shared, "HOT", hot)
    got = sorted(map(tuple, quality.score_quality(docs, labels).collect()))
    assert [r[0] for r in got] == [r[0] for r in want] and [r[-1] for r in got] == [r[-1] for r in want]
    np.testing.assert_allclose([r[1:5] for r in got], [r[1:5] for r in want])
    # Posteriors once more, from the evidence alone.
    rows = {r[0]: r for r in got}
    site = {r["doc_id"]: (r["source"], r["lang"]) for r in docs.select("doc_id", "source", "lang").collect()}
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    share = sum(good[r[0]] for r in got) / len(got)
    prior = math.log(share / (1 - share))
    listed = [(site[r[0]], 1 / (1 + math.exp(-(r[1] + prior)))) for r in got]
    whole = sum(c for _, c in listed) / len(listed)

    def strength(groups):
        n = sum(len(g) for g in groups)
        p = [(sum(g) / len(g), len(g)) for g in groups]
        mean = sum(a * k for a, k in p) / n
        spread = sum(a * a * k for a, k in p) / n - mean * mean
        noise = mean * (1 - mean) * len(groups) / n
        return min(max(mean * (1 - mean) / max(spread - noise, 1e-9), quality.LEAST_STRENGTH), quality.MOST_STRENGTH)

    by_host, by_path = {}, {}
    for (host, path), c in listed:
        by_host.setdefault(host, []).append(c)
        by_path.setdefault((host, path), []).append(c)
    a, b = strength(list(by_host.values())), strength(list(by_path.values()))
    for i, r in rows.items():
        host, path = site[i]
        host_share = (sum(by_host[host]) + a * whole) / (len(by_host[host]) + a)
        site_share = (sum(by_path[host, path]) + b * host_share) / (len(by_path[host, path]) + b)
        score = 1 / (1 + math.exp(-(r[1] + math.log(site_share / (1 - site_share)))))
        np.testing.assert_allclose(r[2:5], (host_share, site_share, score), rtol=1e-9)
        assert r[5] == (score >= 0.5)
