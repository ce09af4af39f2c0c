"""Document quality by hierarchical empirical Bayes.

A logistic classifier on simple text statistics gives each document its evidence, as a
log-likelihood ratio between good and bad. Sites form a hierarchy: all documents, the
host (here: the source) and the path below it (here: the source's part in a language).
Each level's share of good documents has a beta posterior whose prior is the level
above; the prior's strength is estimated from the spread of the shares (moments), so
sparse sites shrink toward their host and hosts toward the global share. A document's
score combines its evidence with its site's posterior. All site figures come from
grouped aggregation over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import even_join, narrow_input, small, spool
from .textscan import PowerTable, buffers, steps, word_hashes

#: Labelled rows that the classifier is fitted on, at most (the least by a hash of doc_id).
SAMPLE = 20_000
#: Sites, with names of some 100 bytes, that are broadcast at most.
SITES = 100_000
#: Bounds of the strength of a prior, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 20.0, 100_000.0

FEATURES = (
    "upper", "lower", "digits", "blanks", "lines", "stops", "commas", "bars", "bangs", "symbols", "other", "wide",
    "word_length", "long_words", "distinct", "repeated", "length",
)


def _classes() -> np.ndarray:
    kind = np.full(256, 10)
    kind[65:91], kind[97:123], kind[48:58] = 0, 1, 2
    kind[[32, 9, 11, 12]], kind[[10, 13]] = 3, 4
    for chars, k in ((b".?", 5), (b",;:'\"()-", 6), (b"|", 7), (b"!", 8), (b"#$%&*@^~_=+<>{}[]\\/", 9)):
        kind[list(chars)] = k
    kind[128:192], kind[192:] = 12, 11
    return kind


def text_statistics(texts: pa.Array, powers: PowerTable) -> np.ndarray:
    """One row of ``FEATURES`` per text: shares of bytes by class, word lengths, and repetition."""
    raw, offsets = buffers(texts)
    kinds, out = _classes(), np.zeros((len(texts), len(FEATURES)))
    for a, b in steps(offsets):
        words, bounds = word_hashes(raw, offsets[a : b + 1], powers)
        for i in range(a, b):
            data = raw[offsets[i] : offsets[i + 1]]
            own = words[bounds[i - a] : bounds[i - a + 1]]
            if not len(data) or not len(own):
                continue
            counts = np.bincount(kinds[data], minlength=13)
            chars = max(len(data) - counts[12], 1)
            out[i, :12] = counts[:12] / chars
            mean = (chars - counts[3] - counts[4]) / len(own)
            recent = (own[1:] == own[:-1]).mean() if len(own) > 1 else 0.0
            distinct = len(np.unique(own)) / len(own) ** 0.9
            out[i, 12:] = mean / 10, mean > 12, distinct, recent, np.log1p(len(own)) / 10
    return out


def _with_statistics(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    powers = PowerTable()
    for batch in batches:
        found = text_statistics(batch.column(text_at), powers)
        columns = [c for i, c in enumerate(batch.columns) if i != text_at]
        names = [n for i, n in enumerate(batch.schema.names) if i != text_at]
        lists = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], found.ravel())
        yield pa.RecordBatch.from_arrays([*columns, lists], [*names, "statistics"])


def _expanded(x: np.ndarray) -> np.ndarray:
    """Statistics and their capped square roots, which separate traces from none."""
    return np.column_stack([x, np.sqrt(np.abs(x[:, :12]))])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, penalty: float = 1e-2) -> dict:
    """Logistic regression by Newton steps; the prior log-odds are taken out of the bias."""
    if not len(y) or y.min() == y.max():
        return {"mean": None, "share": float((y.sum() + 1) / (len(y) + 2))}
    x = _expanded(x)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([np.clip((x - mean) / spread, -8, 8), np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + penalty / 10 * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + penalty / 10 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "spread": spread, "w": w, "share": float(y.mean())}


def log_ratio(model: dict, x: np.ndarray) -> np.ndarray:
    """Evidence of each document for good, without the prior."""
    if model["mean"] is None:
        return np.zeros(len(x))
    z = np.clip((_expanded(x) - model["mean"]) / model["spread"], -8, 8)
    prior = np.log(model["share"] / (1 - model["share"]))
    return np.clip(z @ model["w"][:-1] + model["w"][-1] - prior, -20, 20)


def _with_evidence(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    powers = PowerTable()
    for batch in batches:
        evidence = log_ratio(model, text_statistics(batch.column(4), powers))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(evidence)], ["doc_id", "mark", "host", "path", "evidence"])


def _strength(shares: DataFrame, share: str, weight: str) -> Column:
    """Moment estimate of a prior's strength from the spread of shares around their mean, bounded."""
    n = F.sum(weight)
    mean = F.sum(F.col(share) * F.col(weight)) / n
    spread = F.sum(F.col(share) * F.col(share) * F.col(weight)) / n - mean * mean
    noise = mean * (1 - mean) * F.count("*") / n
    strength = mean * (1 - mean) / F.greatest(spread - noise, F.lit(1e-9))
    return F.least(F.greatest(strength, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))


def _joined(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Join on keys that may be null: ``right`` is broadcast if a count shows that it is small, else frequent keys of ``left`` are dealt by a hash of ``by``."""
    key = F.to_json(F.array(*keys)).alias("_key")  # nulls and texts stay apart
    figures = right.select(key, *(c for c in right.columns if c not in keys))
    return even_join(left.select("*", key), figures, "_key", by=by, limit=SITES).drop("_key")


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> dict:
    marked = (
        narrow_input(labels, doc_id=id_col, label=label_col).where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id").agg(F.max("label").cast("double").alias("label")).orderBy(F.xxhash64("doc_id")).limit(SAMPLE)
    )
    rows = (
        narrow_input(docs, doc_id=id_col, text=text_col).join(F.broadcast(marked), "doc_id").select("doc_id", "label", "text")
        .mapInArrow(lambda it: _with_statistics(it, 2), "doc_id long, label double, statistics array<double>")
        .orderBy(F.xxhash64("doc_id"), "label").limit(2 * SAMPLE).toPandas()
    )
    x = np.array(rows["statistics"].tolist()).reshape(len(rows), len(FEATURES))
    return fit(x, rows["label"].to_numpy(float))


def _mark(text: Column, host: Column, path: Column) -> Column:
    """What a row's decision rests on beside its id, as a number."""
    return F.xxhash64(text, host.cast("string"), path.cast("string"))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    host_col: str = "source", path_col: str = "lang", label_col: str = "quality",
) -> DataFrame:
    """``(doc_id, evidence, host_share, site_share, score, kept)``, one row per row of ``docs``.

    ``kept`` is whether the score, the posterior probability of good, is at least 0.5.
    A null, empty or blank text has all statistics 0; very long texts are read whole; a
    null host or path is a site of its own; of several labels of an id the largest
    counts, labels other than 0 and 1 are ignored. Without labels of both kinds there is
    no evidence and every document gets the smoothed global share. Repeated rows each get
    their row; other columns are ignored; an empty table gives no rows.
    """
    return _scored(docs, labels, id_col, text_col, host_col, path_col, label_col).drop("mark")


def drop_low_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    host_col: str = "source", path_col: str = "lang", label_col: str = "quality",
) -> DataFrame:
    """``docs`` without the rows that ``score_quality`` rejects, each by its own text and site, with or without an id.

    Rows that repeat and columns stay.
    """
    columns = (id_col, text_col, host_col, path_col, label_col)
    rejected = small(spool(_scored(docs, labels, *columns).where("not kept").select("doc_id", "mark").distinct(), "rejected"))
    same = _mark(docs[f"`{text_col}`"], docs[f"`{host_col}`"], docs[f"`{path_col}`"]) == rejected["mark"]
    return docs.join(rejected, same & docs[f"`{id_col}`"].cast("long").eqNullSafe(rejected["doc_id"]), "left_anti")


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, label_col: str) -> DataFrame:
    model = train(docs, labels, id_col, text_col, label_col)
    share = model["share"]
    rows = spool(
        narrow_input(docs, doc_id=id_col, host=host_col, path=path_col, text=text_col)
        .select(F.col("doc_id").cast("long"), _mark(F.col("text"), F.col("host"), F.col("path")).alias("mark"), F.col("host").cast("string"), F.col("path").cast("string"), "text")
        .mapInArrow(lambda it: _with_evidence(it, model), "doc_id long, mark long, host string, path string, evidence double"),
        "evidence",
    )
    prior = float(np.log(share / (1 - share)))
    chance = 1 / (1 + F.exp(-(F.col("evidence") + prior)))
    paths = spool(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(chance).alias("good")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    whole = paths.agg((F.sum("good") / F.sum("n")).alias("global_share"))
    host_strength = hosts.select((F.col("host_good") / F.col("host_n")).alias("p"), "host_n").agg(_strength(hosts, "p", "host_n").alias("host_strength"))
    path_strength = paths.select((F.col("good") / F.col("n")).alias("p"), "n").agg(_strength(paths, "p", "n").alias("path_strength"))
    levels = whole.crossJoin(host_strength).crossJoin(path_strength).first()
    if levels is None or levels["global_share"] is None:
        levels = {"global_share": share, "host_strength": LEAST_STRENGTH, "path_strength": LEAST_STRENGTH}
    a, b, g = levels["host_strength"], levels["path_strength"], levels["global_share"]
    hosts = hosts.withColumn("host_share", (F.col("host_good") + a * g) / (F.col("host_n") + a)).select("host", "host_share")
    sites = _joined(paths, hosts, ["host"], by="path").withColumn("site_share", (F.col("good") + b * F.col("host_share")) / (F.col("n") + b))
    scored = _joined(rows, sites.select("host", "path", "host_share", "site_share"), ["host", "path"], by="doc_id")
    inside = F.least(F.greatest("site_share", F.lit(1e-6)), F.lit(1 - 1e-6))
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.log(inside / (1 - inside)))))
    return scored.select("doc_id", "mark", "evidence", "host_share", "site_share", score.alias("score"), (score >= 0.5).alias("kept"))
