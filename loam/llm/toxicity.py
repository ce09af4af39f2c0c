"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Each text gives counts of its hashed character 3- to 7-grams (lower-cased). Grams whose
share of texts differs between the labels by ``SIGNIFICANT`` standard errors are features;
a gram's log-count ratio between the labels scales its count, and a logistic regression
on the scaled counts, divided by the root of the text's number of grams, gives the score.
(Wang and Manning 2012.) The fit uses a bounded, balanced sample of the labelled training
rows (``SAMPLE`` a label), the least by a hash of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import narrow_input

BITS = 20
GRAMS = (3, 4, 5, 6, 7)
#: Standard errors by which a gram's share must differ between the labels.
SIGNIFICANT = 4.0
#: Added to a gram's counts, in proportion to the labels' sizes.
SMOOTHING = 5.0
#: Labelled rows of each label that the classifier is fitted on, at most.
SAMPLE = 1_500
#: Texts with a crc32 of the id divisible by this are held out.
FOLDS = 5


def grams(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text, repeats included."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    parts, h = [], codes.copy()
    for n in range(2, max(GRAMS) + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) ^ codes[n - 1 :]
        if n in GRAMS:
            m = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            parts.append((m ^ (m >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def fit(texts: list[str], labels: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights per bucket (ratios folded in) and a bias; both labels weigh the same."""
    size, n = 1 << BITS, len(labels)
    if not n or labels.min() == labels.max():
        share = (labels.sum() + 1) / (n + 2)
        return np.zeros(size, np.float32), float(np.log(share / (1 - share)))
    counts, seen = np.zeros((2, size)), np.zeros((2, size))
    for text, label in zip(texts, labels, strict=True):
        buckets, repeats = np.unique(grams(text), return_counts=True)
        counts[label, buckets] += repeats
        seen[label, buckets] += 1
    sizes = np.array([n - labels.sum(), labels.sum()], float)
    prior = SMOOTHING * 2 * sizes / n
    ratio = np.log((counts[1] + prior[1]) / (sizes[1] + prior[1])) - np.log((counts[0] + prior[0]) / (sizes[0] + prior[0]))
    p = seen.sum(axis=0) / n
    error = np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / sizes).sum())
    ratio[np.abs(seen[1] / sizes[1] - seen[0] / sizes[0]) < SIGNIFICANT * error] = 0
    columns, values, owners = [], [], []
    for i, text in enumerate(texts):
        found = grams(text)
        buckets, repeats = np.unique(found[ratio[found] != 0], return_counts=True)
        columns.append(buckets)
        values.append(ratio[buckets] * repeats / np.sqrt(max(len(found), 1)))
        owners.append(np.full(len(buckets), i))
    column, x, owner = (np.concatenate(c) for c in (columns, values, owners))
    used, column = np.unique(column, return_inverse=True)
    weight = 0.5 / sizes[labels]
    w, bias = np.zeros(len(used)), 0.0
    # Adam on the whole sample: deterministic.
    m = v = np.zeros(len(used))
    mb = vb = 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(owner, weights=w[column] * x, minlength=n) + bias
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight
        g, gb = np.bincount(column, weights=miss[owner] * x, minlength=len(used)), miss.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w = w - rate * m / (np.sqrt(v) + 1e-8)
        bias -= rate * mb / (np.sqrt(vb) + 1e-12)
    out = np.zeros(size, np.float32)
    out[used] = w * ratio[used]
    return out, float(bias)


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    w, bias = fit([t for _, _, t in rows], np.array([y for _, y, _ in rows], np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, float]:
    """Fit on the bounded sample, in one task; only the weights (4 MB) come to the driver."""
    marked = (
        narrow_input(labels, doc_id=id_col, label=label_col)
        .where(f"label in (0, 1) and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % {FOLDS} <> 0")
        .groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    )
    key = F.xxhash64("doc_id")
    sample = marked.where("label = 0").orderBy(key).limit(SAMPLE).unionByName(marked.where("label = 1").orderBy(key).limit(SAMPLE))
    texts = narrow_input(docs, doc_id=id_col, text=text_col).join(F.broadcast(sample), "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    row = (
        texts.orderBy(F.xxhash64("doc_id")).limit(3 * SAMPLE).coalesce(1)
        .mapInArrow(_fitted, "weights binary, bias double").first()
    )
    if row is None:
        return fit([], np.zeros(0, np.int64))
    return np.frombuffer(row["weights"], np.float32), row["bias"]


def _scored(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = []
        for t in batch.column(1):
            found = grams(t.as_py() or "")
            z = bias + float(weights[found].sum(dtype=np.float64)) / np.sqrt(max(len(found), 1))
            scores.append(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``.

    A null or empty text is scored as a text without n-grams; a null id is not held
    out; labels that are null or neither 0 nor 1 are ignored, of several labels of an
    id the largest counts; repeated rows each get their row. Without labels of both
    kinds the score is the smoothed share of label 1. Other columns are ignored.
    """
    weights, bias = train(docs, labels, id_col, text_col, label_col)
    scored = narrow_input(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        lambda it: _scored(it, weights, bias), "doc_id long, score double"
    )
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
