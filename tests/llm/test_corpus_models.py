"""Language model, filter audit and clustered layout against plain versions, and their edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loam.llm import audit, layout, lm, queries
from loam.llm.shared import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in WHITE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def fold(word):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


def remainder(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


# Language model


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney from dictionaries; gives p(word | history)."""
    grams = Counter()
    words = Counter()
    for text in texts:
        tokens = [fold(w) for w in words_of(text)] + ["</s>"]
        words.update(tokens)
        padded = ["<s>"] * (order - 1) + tokens
        grams.update(tuple(padded[i : i + order]) for i in range(len(tokens)))
    levels = {order: grams}
    for n in range(order - 1, 0, -1):
        lower = Counter()
        for g, c in levels[n + 1].items():
            lower[g[1:]] += c if g[1] == "<s>" else 1
        levels[n] = lower

    def off(n):
        k = Counter(levels[n].values())
        if k[1] and k[2] and k[3]:
            y = k[1] / (k[1] + 2 * k[2])
            d = (1 - 2 * y * k[2] / k[1], 2 - 3 * y * k[3] / k[2], 3 - 4 * y * k[4] / k[3])
            if all(0 < x <= i + 1 for i, x in enumerate(d)):
                return d
        return 0.5, 1.0, 1.5

    taken = {n: off(n) for n in levels}
    context = {n: defaultdict(lambda: [0, 0, 0, 0]) for n in levels}
    for n, counts in levels.items():
        for g, c in counts.items():
            x = context[n][g[:-1]]
            x[0] += c
            x[min(c, 3)] += 1

    def p(word, history, n):
        if n == 0:
            return 1 / (len(words) + 1)
        h = tuple(history[len(history) - n + 1 :]) if n > 1 else ()
        lower = p(word, history, n - 1)
        if h not in context[n]:
            return lower
        total, *kinds = context[n][h]
        c = levels[n].get((*h, word), 0)
        kept = c - taken[n][min(c, 3) - 1] if c else 0
        return (kept + sum(k * d for k, d in zip(kinds, taken[n], strict=True)) * lower) / total

    return words, p


def plain_scores(docs, order):
    words, p = plain_model([t for i, t in docs if remainder(i, 7) != 2], order)
    n, v = sum(words.values()), len(words)
    out = []
    for i, text in docs:
        tokens = [fold(w) for w in words_of(text)] + ["</s>"]
        history, score, base = ["<s>"] * (order - 1), 0.0, 0.0
        for t in tokens:
            score += math.log10(p(t, history, order))
            base += math.log10((words[t] + 1) / (n + v + 1))
            history.append(t)
        out.append((i, remainder(i, 7) == 2, len(tokens), sum(words[t] > 0 for t in tokens), n, base, score))
    return out


def same_scores(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:7] for r in got], [r[5:7] for r in want], rtol=1e-9, atol=1e-9)


LM = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def texts_of_few_words(n=150, seed=1):
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choice("ab cd Ef gh ij kl mn".split()) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    return [*docs, (None, "ab CD"), (3, docs[3][1]), (3, docs[3][1]), (n, None), (n + 1, " \t\n"), (n + 2, "ÄB ab zz\x85y " * 3), (n + 3, "ab " * 30_000)]


@pytest.mark.parametrize("order", [2, 3])
def test_model_equals_a_plain_one(spark, order):
    docs = texts_of_few_words()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "held_out": F.lit(1), "shard": F.lit(2)}).repartition(5)
    same_scores(lm.score_texts(df, order).select(*LM).collect(), plain_scores(docs, order))


def test_model_over_a_whole_table(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEP", 5_000)
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = queries.op11_language_model(spark, SF)
    same_scores(got.select(*LM).collect(), plain_scores(docs, lm.ORDER))
    held = got.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.min("perplexity")).first()
    assert held[0] > held[1] and held[2] > 1


def test_counts_in_many_parts(spark, monkeypatch):
    """Counts that tasks pass on in several runs add up."""
    counted = lm.Model("file:///none", 3, 2)
    monkeypatch.setattr(lm, "FLUSH", 7)
    texts = ["a b a b", "b a", "", "a a a a a a a a a"] * 3
    batches = (pa.RecordBatch.from_arrays([pa.array([t])], ["text"]) for t in texts)
    runs = [r for batch in lm._word_runs(batches, counted.bits) for r in batch.column(1).to_pylist()]
    total = Counter()
    for run in runs:
        key, n = lm.unpack(run)
        total.update(dict(zip(key.tolist(), n.tolist(), strict=True)))
    assert sorted(total.values()) == sorted([3 * 12, 3 * 3, 12]) and len(runs) > 3


def test_probabilities_sum_to_one(spark):
    docs = texts_of_few_words(60)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = lm.train(df, 3)
    arrays = lm.Arrays(model, 3)
    every = np.arange(1, arrays.words + 2, dtype=np.uint64)
    every[-1] = lm.UNKNOWN
    for history in ([lm.BEGIN, lm.BEGIN], [1, 2], [3, lm.UNKNOWN], [lm.BEGIN, 4]):
        grams = [np.full(len(every), h, np.uint64) for h in history] + [every]
        assert abs(arrays.probabilities(grams).sum() - 1) < 1e-9


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if remainder(i, 7) == 2)
    got = lm.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [tuple(r)[:7] for r in got] == [(held, True, 3, 0, 0, 0.0, 0.0)]
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_round_trip():
    rng = np.random.default_rng(0)
    columns = [np.sort(rng.integers(0, 1 << 63, 50).astype(np.uint64)), rng.integers(0, 300, 50).astype(np.uint64), np.zeros(50, np.uint64)]
    assert all((a == b).all() for a, b in zip(lm.unpack(lm.pack(columns)), columns, strict=True))


def test_discounts_stand_in_where_counts_give_none():
    assert lm.discounts(0, 0, 0, 0).tolist() == [0, 0.5, 1.0, 1.5] == lm.discounts(5, 0, 3, 1).tolist()
    assert 0 < lm.discounts(100, 40, 20, 10)[1] < 1


# Filter audit


def plain_audit(docs, labels):
    good, toxic, first = set(), set(), {}
    for i, q, t, _ in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if t == 1 else set()
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    fails = []
    for i, text, _, source in docs:
        text = text or ""
        w = words_of(text)
        found = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text)]
        found.append(i is not None and i > first[text])
        fails.append((source or "", dict(zip("ABCDE", found, strict=True)), i is not None and i in good, i is not None and i in toxic))
    out = {}
    for order in permutations("ABCDE"):
        for part in {f[0] for f in fails}:
            for step, letter in enumerate(order):
                row = [0] * 6
                for _, failed, is_good, is_toxic in (f for f in fails if f[0] == part):
                    before = any(failed[x] for x in order[:step])
                    removed = failed[letter] and not before
                    only = failed[letter] and sum(failed.values()) == 1
                    for k, x in enumerate((not before and not failed[letter], removed, failed[letter] and before, only, removed and is_good, removed and is_toxic)):
                        row[k] += x
                out[part, "".join(order), step + 1] = row
    shapley = Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return sorted((*key, *row, shapley[key[0], key[1][key[2] - 1]]) for key, row in out.items())


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
LABELS = "doc_id long, quality int, toxic int, part string"


def test_audit_equals_a_plain_one(spark):
    rng = random.Random(5)
    few = ["lorem", "ipsum", "Dolor", "#tag", "A", "x\u00e9"]
    docs = []
    for i in range(60):
        n = rng.choice([3, 150, 260])
        docs.append((i, rng.choice([" ", "\n", "\x0b\t"]).join(rng.choice(few) if rng.random() < 0.5 else f"w{rng.randint(0, 999)}" for _ in range(n)), "en", rng.choice(["a", "b", None])))
    docs += [(60 + k, docs[k][1], "en", "c") for k in range(8)] + [docs[0], docs[0], (None, docs[1][1], "en", "a"), (None, None, None, None), (90, None, None, ""), (91, "", "en", "a"), (92, "v w " * 20_000, "en", "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1]), "z") for i in range(80)] + [(3, 1, 1, "z"), (None, 1, 1, "z")]
    df = spark.createDataFrame(docs, DOCS).withColumns({"n": F.lit("x"), "mask": F.lit(0), "good": F.lit("y"), "words": F.lit(1)})
    got = audit.audit_filters(df, spark.createDataFrame(labels, LABELS)).select(*AUDIT).collect()
    assert sorted(tuple(r) for r in got) == plain_audit(docs, labels)


def test_audit_of_nothing(spark):
    none, no_labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.audit_filters(none, no_labels).count() == 0
    got = audit.audit_filters(spark.createDataFrame([(1, "x", "en", "a")], DOCS), no_labels)
    assert got.count() == 600 and got.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_audit_edges(spark):
    counts = spark.createDataFrame([("p", 3, 10, 1, 0), ("p", 0, 5, 0, 0), ("p", 16, 2, 2, 1)], "part string, mask int, n long, good long, toxic long")
    got = {(r["before"], r["filter"]): r for r in audit.edges(counts, "ABCDE").collect()}
    assert len(got) == 80
    assert got[0, 0]["removed"] == 10 and got[2, 0]["removed"] == 0 and got[2, 0]["redundant"] == 10 and got[3, 4]["unique_fails"] == 2


# Clustered layout


def plain_layout(docs):
    rows = [(((0, b"") if s is None else (1, s.encode())), ((0, b"") if g is None else (1, g.encode())), -1 if t is None else len(t.encode()), -1 if i is None else remainder(i, 365), i) for i, t, g, s in docs]
    n = len(rows)
    cells = []
    for k in range(4):
        ordered = sorted(r[k] for r in rows)
        below = {}
        for place, v in enumerate(ordered):
            below.setdefault(v, place)
        cells.append([8 * below[r[k]] // n for r in rows])
    placed = []
    for i, cell in zip((r[4] for r in rows), zip(*cells, strict=True), strict=True):
        z = 0
        for digit in (2, 1, 0):
            for c in cell:
                z = 2 * z + (c >> digit & 1)
        placed.append((z, i is not None, i or 0, cell))
    placed.sort()
    files = [placed[a : a + layout.FILE_ROWS] for a in range(0, n, layout.FILE_ROWS)]
    out = []
    bounds = [[(min(r[3][k] for r in f), max(r[3][k] for r in f)) for k in range(4)] for f in files]
    for at, (z, known, i, cell) in enumerate(placed):
        query = [(c - r, c + r) for c, r in zip(cell, (0, 0, 1, 1), strict=True)]
        touched = sum(all(lo <= b and hi >= a for (lo, hi), (a, b) in zip(f, query, strict=True)) for f in bounds)
        matching = sum(any(all(a <= c <= b for c, (a, b) in zip(r[3], query, strict=True)) for r in f) for f in files)
        file = at // layout.FILE_ROWS
        out.append((i if known else None, z, at, file, touched, matching, ",".join(str(x) for pair in bounds[file] for x in pair)))
    return out


def test_layout_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(layout, "FILE_ROWS", 7)
    monkeypatch.setattr(layout, "FAN", 3)
    rng = random.Random(3)
    docs = [(i, "\u00e9" * rng.choice([0, 1, 5, 80, 300]), rng.choice(["en", "de", "\ud7ff", "\U0001f600", "", None]), rng.choice(["hot", "hot", *"abcdefghijk", None])) for i in range(400)]
    docs += [(None, None, None, None), (None, "x", "en", "a"), (500, None, "en", "a"), (-3, "y" * 200_000, "en", "hot")] + [docs[5]] * 30
    df = spark.createDataFrame(docs, DOCS).withColumns({"length": F.lit("x"), "n": F.lit(1), "date": F.lit(2), "position": F.lit(3)})
    got = layout.clustered_layout(df)
    assert got.columns == ["doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds"]
    assert [tuple(r) for r in got.orderBy("position").collect()] == plain_layout(docs)


def test_layout_of_little(spark):
    assert layout.clustered_layout(spark.createDataFrame([], DOCS)).count() == 0
    one = layout.clustered_layout(spark.createDataFrame([(7, "x", "en", "a")], DOCS)).collect()
    assert [tuple(r) for r in one] == [(7, 0, 0, 0, 1, 1, "0,0,0,0,0,0,0,0")]


def test_layout_without_python_or_single_task(spark):
    plan = layout.place_rows(table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan
