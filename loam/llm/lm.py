"""Language-model scoring by interpolated modified Kneser-Ney (Chen and Goodman 1998).

Spark counts the n-grams of the training texts: tasks count what they read, the counts
are shuffled by shard, and each shard is summed, sorted by hash and written as arrays to
the shared folder. A level's shards also give the counts of the level below (in how many
contexts an n-gram continues, what follows a context), which are shuffled and written in
turn. Workers map these files into memory, so that processes of a machine share the
pages, and look n-grams up by binary search.

A word is its place in the sorted hash arrays of the vocabulary; an n-gram is the 64-bit
hash of its words. Words and n-grams whose hashes are equal count as one; with 10^8
n-grams the chance of any such pair is 3e-4. The shared folder must be a mounted one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, narrow_input, small_batches, spool
from .textscan import PowerTable, buffers, mix, steps, word_hashes

#: Words of the longest n-grams.
ORDER = 2
#: Texts with a crc32 of the id that leaves this remainder are held out.
FOLDS, HELD_OUT = 7, 2
#: Tokens that a task counts before it passes the counts on.
FLUSH = 2_000_000
#: Bytes of text that are scored at a time; a longer text is a step of its own.
STEP = 4 << 20

#: Ids: what stands before a text, and what isn't in the vocabulary; words count from 1.
BEGIN, UNKNOWN = np.uint64(0), np.uint64(1 << 63)
#: The hash of the end of a text, which is a token.
END = mix(np.array([0x656E64], np.uint64))[0]
#: Discounts of counts 1, 2 and 3 or more where the counts of counts give none.
DISCOUNTS = (0.5, 1.0, 1.5)

_HEAD = 16
_RUNS = "shard int, run binary"


class Model(NamedTuple):
    """Where the arrays are, in ``2 ** bits`` shards a level; level 0 is the vocabulary."""

    folder: str
    bits: int
    order: int


def _local(folder: str) -> str:
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"arrays are mapped into memory, so the shared folder has to be mounted on every node, not {folder}")
    return parts.path


def _key(words: list[np.ndarray]) -> np.ndarray:
    out = mix(words[0] + np.uint64(len(words)))
    for w in words[1:]:
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + w)
    return out


# Runs: n-grams with their counts on the way to their shard.


def pack(columns: list[np.ndarray]) -> bytes:
    """Integer columns, the first one ascending, as planes of bytes, which compress well."""
    columns = [np.diff(columns[0], prepend=np.uint64(0)), *columns[1:]]
    widths = [max(1, (int(c.max()).bit_length() + 7) // 8) for c in columns]
    planes = [np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for c, w in zip(columns, widths, strict=True)]
    return bytes([len(columns), *widths]) + b"".join(planes)


def unpack(run: bytes) -> list[np.ndarray]:
    widths = run[1 : 1 + run[0]]
    at, n = 1 + run[0], (len(run) - 1 - run[0]) // sum(widths)
    out = []
    for w in widths:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :w] = np.frombuffer(run, np.uint8, w * n, at).reshape(w, n).T
        out.append(wide.view("<u8").ravel())
        at += w * n
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _merged(key: np.ndarray, words: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """One row a key, ascending, with sums of its values."""
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[starts], [w[order[starts]] for w in words], [np.add.reduceat(v[order], starts) for v in values]


def _runs(key: np.ndarray, words: list[np.ndarray], values: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Counts summed by key, one run a shard."""
    if not len(key):
        return
    key, words, values = _merged(key, words, values)
    shards = (key >> np.uint64(64 - bits)).astype(np.int32)
    found, starts = np.unique(shards, return_index=True)
    runs = []
    for a, b in zip(starts, [*starts[1:], len(key)], strict=True):
        order = np.argsort(words[0][a:b])
        runs.append(pack([c[a:b][order] for c in (*words, *values)]))
    for i in range(0, len(runs), 64):
        yield pa.RecordBatch.from_arrays([pa.array(found[i : i + 64]), pa.array(runs[i : i + 64], pa.binary())], ["shard", "run"])


def _tokens(texts: pa.Array, powers: PowerTable, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words of some texts, each text with its end, and where texts start."""
    raw, offsets = buffers(texts)
    for a, b in steps(offsets, limit):
        words, bounds = word_hashes(raw, offsets[a : b + 1], powers)
        yield np.insert(words, bounds[1:], END), bounds[:-1] + np.arange(b - a)


def _word_runs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    powers, held, size = PowerTable(), [], 0
    for batch in batches:
        for words, _ in _tokens(batch.column(0), powers, STEP):
            held.append(words)
            size += len(words)
            if size >= FLUSH:
                every = np.concatenate(held)
                held, size = [], 0
                yield from _runs(every, [every], [np.ones(len(every), np.uint64)], bits)
    if size:
        every = np.concatenate(held)
        held = []
        yield from _runs(every, [every], [np.ones(size, np.uint64)], bits)


def histories(ids: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """The ids ``order - 1`` to 1 places before each token, ``BEGIN`` before its text, then the ids."""
    place = np.arange(len(ids)) - np.repeat(starts, np.diff([*starts, len(ids)]))
    out = [ids]
    for back in range(1, order):
        before = np.full(len(ids), BEGIN)
        before[back:] = ids[:-back] if len(ids) > back else before[back:]
        out.insert(0, np.where(place >= back, before, BEGIN))
    return out


def _gram_runs(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    arrays, powers, held, size = opened(model, 0), PowerTable(), [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        grams = [np.concatenate(w) for w in zip(*held, strict=True)]
        held.clear()
        yield from _runs(_key(grams), grams, [np.ones(len(grams[0]), np.uint64)], model.bits)

    for batch in batches:
        for words, starts in _tokens(batch.column(0), powers, STEP):
            held.append(histories(arrays.ids(words)[0], starts, model.order))
            size += len(words)
            if size >= FLUSH:
                yield from flush()
                size = 0
    if size:
        yield from flush()


def _below(words: list[np.ndarray], count: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """What n-grams give to those of one word less: as continuations and as contexts.

    An n-gram at the start of texts has no other continuation, so its full count goes on.
    """
    n, none = len(count), np.zeros(len(count), np.uint64)
    continues = np.where(words[1] == BEGIN, count, np.uint64(1))
    kinds = [(count == 1).astype(np.uint64), (count == 2).astype(np.uint64), (count > 2).astype(np.uint64)]
    short = [np.concatenate([a, b]) for a, b in zip(words[1:], words[:-1], strict=True)]
    values = [np.concatenate([continues, none]), *(np.concatenate([none, v]) for v in (count, *kinds))]
    yield from _runs(_key(short), short, values, bits)


def _write_shards(batches: Iterator[pa.RecordBatch], model: Model, level: int) -> Iterator[pa.RecordBatch]:
    """Sum and sort each shard's runs, write its arrays, and pass on what the level below needs."""
    held, at = [], None
    passed, size = [], 0
    n_words = max(level, 1)
    done = []

    def close() -> None:
        nonlocal size
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        words, values = columns[:n_words], columns[n_words:]
        key, words, values = _merged(_key(words) if level else words[0], words, values)
        _write_arrays(model, level, at, key, values)
        done.append((level, at, len(key)))
        if level > 1:
            passed.append([*words, values[0]])
            size += len(key)

    def below() -> Iterator[pa.RecordBatch]:
        nonlocal size
        columns = [np.concatenate(c) for c in zip(*passed, strict=True)]
        passed.clear()
        size = 0
        yield from _below(columns[:-1], columns[-1], model.bits)

    for batch in batches:
        for shard, run in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if at is not None and shard != at:
                close()
                held = []
                if size >= FLUSH // 2:
                    yield from below()
            at = shard
            held.append(unpack(run.as_py()))
    if at is not None:
        close()
    if size:
        yield from below()
    if level <= 1 and done:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], ["level", "shard", "entries"])


def _path(model: Model, level: int, shard: int | None = None) -> str:
    folder = f"{_local(model.folder)}/level-{level}"
    return folder if shard is None else f"{folder}/{shard:08d}"


def _write_arrays(model: Model, level: int, shard: int, key: np.ndarray, values: list[np.ndarray]) -> None:
    """A head of sizes and counts of counts, the keys, then each value in 4 or, if need be, 8 bytes."""
    os.makedirs(_path(model, level), exist_ok=True)
    widths = [4 if int(v.max()) < 1 << 32 else 8 for v in values]
    head = np.zeros(_HEAD, "<u8")
    head[:6] = len(key), values[0].sum(), *((values[0] == k).sum() for k in (1, 2, 3, 4))
    head[6 : 7 + len(widths)] = len(widths), *widths
    name = _path(model, level, shard)
    draft = f"{name}.{os.getpid()}-{os.urandom(6).hex()}"
    with open(draft, "wb") as out:
        out.write(head.tobytes())
        out.write(key.astype("<u8").tobytes())
        for v, w in zip(values, widths, strict=True):
            out.write(v.astype(f"<u{w}").tobytes())
    os.replace(draft, name)  # a task that runs again writes the same


class Arrays:
    """The sorted hash arrays of a model up to a level, mapped into memory."""

    def __init__(self, model: Model, levels: int) -> None:
        self.model, self.heads, self.maps = model, [], []
        for level in range(levels + 1):
            heads = np.zeros((1 << model.bits, _HEAD), np.int64)
            maps: list[tuple | None] = [None] * (1 << model.bits)
            names = sorted(x for x in os.listdir(_path(model, level)) if "." not in x) if os.path.isdir(_path(model, level)) else []
            for shard in map(int, names):
                raw = np.memmap(_path(model, level, shard), np.uint8, "r")
                heads[shard] = raw[: 8 * _HEAD].view("<i8")
                n, at = int(heads[shard, 0]), 8 * _HEAD
                parts = []
                for w in (8, *heads[shard, 7 : 7 + heads[shard, 6]].tolist()):
                    parts.append(raw[at : at + w * n].view(f"<u{w}"))
                    at += w * n
                maps[shard] = tuple(parts)
            self.heads.append(heads)
            self.maps.append(maps)
        totals = [h.sum(axis=0) for h in self.heads]
        self.words, self.tokens = int(totals[0][0]), int(totals[0][1])
        self.first = np.concatenate([[0], np.cumsum(self.heads[0][:, 0])])
        self.discounts = [discounts(*t[2:6].tolist()) for t in totals]
        self.totals = totals

    def find(self, level: int, key: np.ndarray, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """For ascending keys the place in the level, -1 where absent, and values, 0 where absent."""
        places, values = np.full(len(key), -1, np.int64), [np.zeros(len(key), np.int64) for _ in range(columns)]
        shards = (key >> np.uint64(64 - self.model.bits)).astype(np.int64)
        found, starts = np.unique(shards, return_index=True)
        for shard, a, b in zip(found.tolist(), starts, [*starts[1:], len(key)], strict=True):
            if (held := self.maps[level][shard]) is None:
                continue
            at = np.minimum(np.searchsorted(held[0], key[a:b]), len(held[0]) - 1)
            hit = held[0][at] == key[a:b]
            places[a:b] = np.where(hit, at, -1)
            for v, h in zip(values, held[1:], strict=False):
                v[a:b] = np.where(hit, h[at], 0)
        return places, values

    def ids(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of words by their hashes."""
        key, inverse = np.unique(words, return_inverse=True)
        places, (counts,) = self.find(0, key, 1)
        shards = (key >> np.uint64(64 - self.model.bits)).astype(np.int64)
        ids = np.where(places < 0, UNKNOWN, (self.first[shards] + places + 1).astype(np.uint64))
        return ids[inverse], counts[inverse]

    def values(self, words: list[np.ndarray], columns: int) -> list[np.ndarray]:
        key, inverse = np.unique(_key(words), return_inverse=True)
        return [v[inverse] for v in self.find(len(words), key, columns)[1]]

    def probabilities(self, grams: list[np.ndarray]) -> np.ndarray:
        """Of the last ids, each given those before it."""
        ones, twos = self.heads[1][:, 2].sum(), self.heads[1][:, 3].sum()
        out = np.full(len(grams[0]), 1 / (self.words + 1))
        for n in range(1, self.model.order + 1):
            d = self.discounts[n]
            own = grams[-n:]
            (count,) = self.values(own, 1)
            if n == 1:
                # Of the words' continuations; all words have one.
                total, kinds = np.int64(self.totals[1][1]), (ones, twos, self.words - ones - twos)
            else:
                _, total, *kinds = self.values(own[:-1], 5)
            kept = np.maximum(count - d[np.minimum(count, 3)], 0)
            spread = sum(x * k for x, k in zip(d[1:], kinds, strict=True))
            out = np.where(total > 0, (kept + spread * out) / np.maximum(total, 1), out)
        return out


def discounts(ones: int, twos: int, threes: int, fours: int) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and 3 or more."""
    if ones and twos and threes:
        share = ones / (ones + 2 * twos)
        found = (1 - 2 * share * twos / ones, 2 - 3 * share * threes / twos, 3 - 4 * share * fours / threes)
        if all(0 < x <= k for x, k in zip(found, (1, 2, 3), strict=True)):
            return np.array([0, *found])
    return np.array([0, *DISCOUNTS])


@lru_cache(maxsize=2)
def opened(model: Model, levels: int) -> Arrays:
    return Arrays(model, levels)


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """Count the column ``text`` of all rows and write the arrays; a null text is empty."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Twice as many shards as tasks: what a task holds at a time is a shard.
    model = Model(fresh_path(spark, "lm"), (2 * parts - 1).bit_length(), order)

    def written(runs: DataFrame, level: int, schema: str) -> DataFrame:
        dealt = runs.repartition(parts, "shard").sortWithinPartitions("shard")
        return dealt.mapInArrow(lambda it: _write_shards(it, model, level), schema)

    counted = "level long, shard long, entries long"
    spool(written(texts.mapInArrow(lambda it: _word_runs(it, model.bits), _RUNS), 0, counted), "words")
    rows = texts.mapInArrow(lambda it: _gram_runs(it, model), _RUNS)
    for level in range(order, 0, -1):
        rows = written(rows, level, _RUNS if level > 1 else counted)
    spool(rows, "grams")
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    arrays, powers = opened(model, model.order), PowerTable()
    for batch in batches:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for words, starts in _tokens(batch.column(2), powers, STEP):
            ids, counts = arrays.ids(words)
            base = np.log10((counts + 1) / (arrays.tokens + arrays.words + 1))
            score = np.log10(arrays.probabilities(histories(ids, starts, model.order)))
            each = np.ones(len(words), np.int64), (counts > 0).astype(np.int64), base, score
            for part, x in zip(parts, each, strict=True):
                part.append(np.add.reduceat(x, starts))
        n_tokens, n_known, base, score = (np.concatenate(p) if p else np.zeros(0) for p in parts)
        train_tokens = np.full(len(n_tokens), arrays.tokens)
        columns = [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(train_tokens, pa.int64()), pa.array(base), pa.array(score)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_texts(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)``, one row per row.

    ``score`` is the model's log10 probability of the text with its end; the model learns
    from all rows but those held out. A null text is empty: its one token is its end; a
    null id is not held out; repeated rows each count and are each scored; very long texts
    are counted and scored whole; other columns are ignored. With nothing to learn from,
    all tokens are unknown and all scores 0; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = narrow_input(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    rows = rows.select("doc_id", held_out.alias("held_out"), "text")
    model = train(rows.where("not held_out").select("text"), order)
    scored = rows.mapInArrow(
        lambda it: _scored(it, model),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
