"""Near-duplicates, decontamination, top-k and WARC against brute force."""

import io
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm import decontam, neardup, shared, topk, warc
from loam.llm.components import connected_components

DOCS = "n_shingles long, doc_id long, text string, kept string"


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def plain_components(rows, size, threshold=80):
    """Component per row index, from all pairs of rows with an id."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                    parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) if rows[i][0] is not None else None for i in range(len(rows))], [len(s) for s in sets]


def variants(seed, groups=12, most=60, words=80):
    """Groups of near copies with few and with many changes, exact copies, and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice((1, 2, 3, 5, 8, words, 3 * words)))]
        if g % 3 == 0:
            base = base + passage
        for _ in range(rng.choice((1, 2, 5, most))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, len(base) // 12, len(base) // 8))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "size"), [(1, 2), (2, 5)])
def test_components_equal_brute_force(spark, seed, size, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT_LIST", 4)
    monkeypatch.setattr(neardup, "LARGE", 8)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = variants(seed)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame([(0, i, t, "") for i, t in rows], DOCS), shingle=size).collect()}
    components, sizes = plain_components(rows, size)
    for (i, _), c, n in zip(rows, components, sizes, strict=True):
        assert (got[i]["component_id"], got[i]["n_shingles"], got[i]["kept"]) == (c, n, c == i)


def test_frequent_keys_and_large_tables_give_the_same(spark, monkeypatch):
    from loam.llm import components, shared
    from loam.operators import union

    rows = variants(3, groups=9, most=40)
    want, _ = plain_components(rows, 2)
    for module in (neardup, components, shared, union):
        for name, value in (("BROADCAST_ROWS", 0), ("FREQUENT", 0), ("ONE_TASK", 0), ("HOT", 3), ("SHORT_LIST", 4), ("LARGE", 8), ("BLOCK", 16)):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, value)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame([(0, i, t, "") for i, t in rows], DOCS), shingle=2).collect()}
    assert [got[i] for i, _ in rows] == want


def test_sketches_keep_all_pairs_at_the_threshold():
    """Of a million pairs of Jaccard 0.8 or just above, all share what the filters ask for."""
    rng = np.random.default_rng(0)
    for n, m in ((64, 80), (80, 100), (88, 110), (96, 120), (102, 127), (103, 128)):
        for _ in range(17):
            hashes = rng.integers(0, 1 << 64, (10_000, m), np.uint64)
            inner = np.sort(neardup.signed(hashes[:, :n]), axis=1)[:, :64]
            outer = np.sort(neardup.signed(hashes), axis=1)[:, :64]
            # A inside B: the union is B, so common values of the union's sketch are those of B's sketch in A.
            member = np.zeros(outer.shape, bool)
            for j in range(64):
                member |= outer == inner[:, j : j + 1]
            assert (member.sum(axis=1) >= neardup.NARROW.shared).all()


def test_signed_order_is_unsigned_order():
    hashes = np.array([0, 1, (1 << 63) - 1, 1 << 63, (1 << 64) - 1], np.uint64)
    assert (np.diff(neardup.signed(hashes).astype(object)) > 0).all()


def test_pairs_of_sets_just_longer_than_a_sketch_link(spark):
    rng = random.Random(2)
    rows = []
    for i in range(150):
        words = [f"w{rng.randrange(10**9)}" for _ in range(121)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:97]))]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame([(0, i, t, "") for i, t in rows], DOCS), shingle=2).collect()}
    assert all(got[i] == i // 2 * 2 for i, _ in rows)


def test_a_repeated_id_is_one_set_for_each_text(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT_LIST", 4)
    words = [f"w{i}" for i in range(100)]
    near = " ".join(words[:-1] + ["other"])
    rows = [(5, " ".join(words))] * 1000 + [(6, near)] * 1000 + [(9, "q r s t")] * 3 + [(5, "q r s t")] + [(7, "alone in the world")] + [(5, "a b c d")]
    df = spark.createDataFrame([(0, i, t, "") for i, t in rows], DOCS)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, shingle=2).collect()}
    assert got == {(5, 99, 5, True), (6, 99, 5, False), (9, 3, 5, False), (5, 3, 5, True), (7, 3, 7, True)}
    kept = sorted((r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(df, shingle=2).collect())
    assert kept == [(5, "a b c d"), (5, "q r s t"), (5, " ".join(words)), (7, "alone in the world")]


def test_a_repeated_id_keeps_the_group_of_its_other_text(spark):
    rows = [(1, "a b c d e f"), (5, "A b c d e f"), (5, "u v w x y z"), (8, "u v w  x y Z"), (None, "u v w x y z"), (4, ""), (4, None), (4, " ")]
    df = spark.createDataFrame([(0, i, t, "") for i, t in rows], DOCS).withColumnRenamed("kept", "root")
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in neardup.drop_near_duplicates(df, shingle=2).collect())
    assert [(i, t.strip()) for i, t in kept] == [(0, "u v w x y z"), (1, "a b c d e f"), (4, ""), (5, "u v w x y z")]


def test_near_duplicate_edge_cases(spark):
    rows = [(5, None), (6, ""), (7, " \t"), (8, "One"), (9, "one"), (9, "one"), (None, "one"), (10, "ÉA b"), (11, "éa b"), (12, "a b " * 20_000), (13, "A  B " * 20_000)]
    got = neardup.near_duplicates(spark.createDataFrame([(0, i, t, "") for i, t in rows], DOCS), shingle=2).collect()
    want = {5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 10, 11: 11, 12: 12, 13: 12, None: None}
    assert len(got) == len(rows) and all(r["component_id"] == want[r["doc_id"]] for r in got)
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    kept = neardup.drop_near_duplicates(spark.createDataFrame([(0, i, t, "") for i, t in [(1, "x y z"), (1, "x y z"), (2, "X Y Z"), (None, "x y z")]], DOCS))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1]


@pytest.mark.parametrize("one_task", [0, 1000])
def test_connected_components(spark, monkeypatch, one_task):
    from loam.operators import union

    monkeypatch.setattr(union, "ONE_TASK", one_task)
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (p != t))
    return min(row)


@given(st.text("ab c", min_size=1, max_size=70), st.text("ab c", max_size=90))
@settings(max_examples=200, deadline=None)
def test_myers_equals_the_table(pattern, text):
    best = least_distance(pattern, text)
    got = decontam.myers(decontam.masks(pattern), len(pattern), text, len(pattern))
    assert (got[0] if got else len(pattern)) == best


@pytest.mark.parametrize("held", [decontam.CHARS_PER_PASS, 50])
def test_decontamination_equals_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(decontam, "CHARS_PER_PASS", held)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(4, 20)))) for i in range(12)] + [(3, "another text of item three"), (50, None), (None, "x y"), (51, " ")]
    docs = []
    for i in range(80):
        text = " ".join(word() for _ in range(rng.randint(0, 60)))
        if i % 3 == 0:
            item = rng.choice(items[:12])[1]
            for _ in range(rng.choice((0, 1, 3, 6))):
                k = rng.randrange(len(item))
                item = item[:k] + rng.choice(["", "zq", "z"]) + item[k + 1 :]
            text = f"{text}  {item.upper()}\n{text}"
        docs.append((0, i, text, ""))
    docs += [(0, 0, docs[0][2], ""), (0, None, items[0][1], ""), (0, 99, None, ""), (0, 98, "", "")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontam.contaminated(spark.createDataFrame(docs, DOCS), tests).collect()}
    want = {}
    for _, i, t, _ in docs:
        for k, item in items:
            if i is not None and k is not None and item and decontam.normal(item):
                pattern = decontam.normal(item)
                d = least_distance(pattern, decontam.normal(t or ""))
                if d <= decontam.budget(len(pattern)):
                    want[i, k] = min(d, want.get((i, k), d))
    assert got == {(*k, d) for k, d in want.items()} and any(d for _, _, d in got)
    small = decontam.contaminated(spark.createDataFrame(docs, DOCS), tests.limit(0))
    assert small.count() == 0 and decontam.contaminated(spark.createDataFrame([], DOCS), tests).count() == 0


def least_distances(pattern, texts, gap=200):
    """Of a pattern to a substring of each text, by rows of one table; no match spans the gaps between the texts."""
    text = np.frombuffer(("\n" * gap).join(texts).encode("utf-32-le"), np.uint32)
    row, places = np.zeros(len(text) + 1, np.int32), np.arange(len(text) + 1, dtype=np.int32)
    for i, c in enumerate(pattern, 1):
        new = np.full_like(row, i)
        np.minimum(row[:-1] + (text != ord(c)), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - places) + places
    begins = np.cumsum([0, *(len(t) + gap for t in texts[:-1])])
    return np.minimum.reduceat(row, begins).tolist()


def test_decontamination_of_whole_tables_equals_brute_force(spark, monkeypatch):
    """Both ways find in ``documents`` what a table of distances of every item to every text gives."""
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [(r["doc_id"], decontam.normal(r["text"] or "")) for r in docs.select("doc_id", "text").collect()]
    texts = [t for _, t in rows]
    want = {}
    for item, pattern in items.select("item_id", "text").collect():
        pattern = decontam.normal(pattern)
        assert decontam.budget(len(pattern)) < 200
        for (doc, _), d in zip(rows, least_distances(pattern, texts), strict=True):
            if d <= decontam.budget(len(pattern)):
                want[doc, item] = min(d, want.get((doc, item), d))
    want = {(*k, d) for k, d in want.items()}
    assert want and {tuple(r) for r in decontam.contaminated(docs, items).collect()} == want
    monkeypatch.setattr(decontam, "CHARS_PER_PASS", 0)
    assert {tuple(r) for r in decontam.contaminated(docs, items).collect()} == want


def test_many_items_and_repeated_texts_without_broadcasts(spark, monkeypatch):
    """A third of the rows has one text, items share a piece and a text; every join is shuffled, hot keys dealt."""
    monkeypatch.setattr(decontam, "CHARS_PER_PASS", 0)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(shared, "HOT", 8)
    items = [(i, f"which of the following statements about number {i % 40} is the one that holds") for i in range(60)]
    hot = f"So {items[7][1]} and aaaa {'a' * 3000}"
    docs = [(0, i, hot if i % 3 == 0 else f"clean text {i}" if i % 3 == 1 else items[i % 40][1].replace("holds", "folds"), "") for i in range(90)]
    docs += [(0, 500, None, ""), (0, None, hot, ""), (0, None, "clean", "")]
    tests = spark.createDataFrame([*items, (99, "a" * 40)], "item_id long, text string")
    frame = spark.createDataFrame(docs, DOCS).withColumnsRenamed({"kept": "key", "n_shingles": "uid"})
    got = {tuple(r) for r in decontam.contaminated(frame, tests).collect()}
    want = set()
    for _, d, t, _ in docs:
        for i, item in [*items, (99, "a" * 40)]:
            if d is not None and t is not None and (e := decontam.myers(decontam.masks(item), len(item), decontam.normal(t), decontam.budget(len(item)))):
                want.add((d, i, e[0]))
    assert got == want and len({d for d, i, _ in got if i == 99}) == 30
    clean = decontam.drop_contaminated(frame, tests)
    assert clean.columns == frame.columns
    dirty = {d for d, _, _ in want}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in clean.collect()) == sorted((d is None, d or 0) for _, d, t, _ in docs if t != hot and d not in dirty)


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontam, "CHARS_PER_PASS", 30)
    items = spark.createDataFrame([(i, f"benchmark question number {i} of many") for i in range(4)], "item_id long, text string")
    docs = spark.createDataFrame([(0, i, f"So: benchmark question number {i} of many.", "") for i in range(4)], DOCS)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).where("distance = 0").collect()}
    assert got == {(i, i) for i in range(4)}


def test_short_items_are_whole_words(spark):
    items = spark.createDataFrame([(1, "yes"), (2, "A"), (3, "to be, or not"), (4, "?!")], "item_id long, text string")
    docs = spark.createDataFrame([(0, 1, "Bayeses and yesterdays", ""), (0, 2, "say Yes!", ""), (0, 3, "to  be, or not.", ""), (0, 4, "ato be, or nots", ""), (0, 5, "a?!b", ""), (0, 6, "x" * 500_000 + " yes", "")], DOCS)
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(2, 1, 0), (3, 3, 0), (5, 2, 0), (5, 4, 0), (6, 1, 0)}
    assert decontam.drop_contaminated(docs, items).count() == 6
    assert {r["doc_id"] for r in decontam.drop_contaminated(docs, items, least=3).collect()} == {1, 4, 5}


def test_decontamination_in_passes(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(8))) for i in range(9)]
    docs = spark.createDataFrame([(0, None if i == 4 else i, f"before {t} after", "") for i, t in items] + [(0, 50, None, ""), (0, 51, "clean", ""), (0, 51, "clean", "")], DOCS)
    tests = spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in decontam.contaminated(docs, tests).collect()}
    monkeypatch.setattr(decontam, "CHARS_PER_PASS", 120)
    assert {tuple(r) for r in decontam.contaminated(docs, tests).collect()} == whole == {(i, i, 0) for i in range(9) if i != 4}
    clean = decontam.drop_contaminated(docs.withColumnRenamed("kept", "_id"), tests)
    assert sorted(r["doc_id"] for r in clean.collect()) == [50, 51, 51] and clean.columns[-1] == "_id"


def plain_top(rows, k=5, every=50):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            usable.setdefault(i, []).append([int(np.floor(256 * x)) for x in v])
    out = set()
    for q, queries in usable.items():
        if q % every == 0:
            best = {}
            for a in queries:
                for c, candidates in usable.items():
                    for b in candidates:
                        if c != q and len(a) == len(b):
                            s = sum(x * y for x, y in zip(a, b, strict=True))
                            best[c] = max(s, best.get(c, s))
            for rank, (c, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
                out.add((q, rank, c, s))
    return out


@pytest.mark.parametrize("n", [0, 1, 4, 300])
def test_top_k_equals_brute_force(spark, n, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 64)
    monkeypatch.setattr(topk, "BLOCK", 2)
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(n)]
    for i in range(20, min(n, 60)):
        rows[i] = (i, rows[10][1])
    if n > 100:
        rows += [rows[3], (None, rows[1][1]), (1000, None), (1001, []), (1002, [float("nan")] * 8), (1003, [None] * 8), (1004, [float("inf")] * 8), (1050, [0.0] * 8), (1100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as rank")
    assert {tuple(r) for r in topk.top_k(df).collect()} == plain_top(rows)


def test_ids_with_many_vectors_count_once(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 16)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in (50, 100, *range(1, 9)) for _ in range(1 if i == 50 else 12)]
    rows += [(7, [3.0 + j / 100] * 8) for j in range(10)] + [(200 + i, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.top_k(df).collect()}
    assert got == plain_top(rows) and sum(q == 50 for q, *_ in got) == 5


def test_large_components_are_exact_or_refused(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 8)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-(1 << 20), 1 << 20, 3)]) for i in range(60)]
    rows += [(60, [float(1 << 20), 1.0, 0.0]), (61, [float(1 << 20), 1.0 + 1 / 256, 0.0]), (100, [float(1 << 20), 1.0, 0.0])]
    schema = "vec_id long, embedding array<double>"
    want = plain_top(rows)
    assert max(s for *_, s in want) > 1 << 53
    assert {tuple(r) for r in topk.top_k(spark.createDataFrame(rows, schema)).collect()} == want
    for large in (4e16, 1e300):
        with pytest.raises(Exception, match="64 bits"):
            topk.top_k(spark.createDataFrame([(3, [large, 0.0]), (50, [large, 2.0])], schema)).collect()


def test_an_id_on_very_many_rows(spark, monkeypatch):
    """Equal rows are one before they are dealt; other vectors of the id are dealt over the shards."""
    monkeypatch.setattr(topk, "SHARD", 512)
    many = spark.range(100_000).selectExpr("50 as vec_id", "array(1D, cast(id % 3 as double)) as embedding")
    few = [(i, [float(i % 7), float(i % 5)]) for i in range(1, 40)]
    df = many.unionByName(spark.createDataFrame(few, "vec_id long, embedding array<double>"))
    assert {tuple(r) for r in topk.top_k(df).collect()} == plain_top(few + [(50, [1.0, float(j)]) for j in range(3)])


@pytest.mark.parametrize("repeats", [1, 3])
def test_max_score_prunes(repeats):
    rng = np.random.default_rng(1)
    n, scale = 2000, 50 / (1 + np.arange(32))
    vectors = np.floor(rng.normal(size=(n, 32)) * scale * 8)
    ids = np.arange(n) // repeats
    shard = topk.Shard(ids, vectors)
    q = np.floor(rng.normal(size=32) * scale * 8)
    full = {}
    for i, s in zip(ids.tolist(), vectors @ q, strict=True):
        full[i] = max(s, full.get(i, s))
    full.pop(7)
    want = sorted(full.items(), key=lambda x: (-x[1], x[0]))[:5]
    got, scores, visited = shard.search(q, 7, 5)
    assert list(zip(got.tolist(), scores.tolist(), strict=True)) == want
    assert visited < 0.5 * n * 32, "most postings of non-essential terms are skipped"
    got, scores, fewer = shard.search(q, 7, 5, floor=want[-1][1])
    assert list(zip(got.tolist(), scores.tolist(), strict=True)) == want and fewer <= visited
    assert len(shard.search(q, 7, 5, floor=want[0][1] + 1)[0]) == 0


def test_components_of_vectors_are_packed_by_their_range():
    for values, width in (([-32768, 32767], 2), ([40_000, 0], 4), ([1 << 40, 0], 8)):
        w, raw = topk._narrow(np.array([values]))
        assert w == width and topk._wide(raw, w, 2).tolist() == [values]


PAGES = "page_id long, url string, html string, digest string"


def test_warc_round_trip(spark):
    long = "é" * 60
    rows = [(4, "http://x/a b\r\n", long), (2, None, long), (3, "u", long), (9, "u", "short"), (8, "u", "short"), (7, "u", None), (1, "u", ""), (None, "u", long), (2, None, long),
            (20, "u", "x" * 99), (21, "u", "x" * 99), (30, "u", "y" * 100), (31, "u", "y" * 100), (None, "u", "z" * 200), (None, "u", "z" * 200), (40, "u", "body\r\n\r\nWARC/1.1\r\n\r\n" * 50)]
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame([(*r, "") for r in rows], PAGES)).collect()), key=str)
    first = {}
    for i, _, t in rows:
        if i is not None and len((t or "").encode()) >= 100:
            first[t] = min(i, first.get(t, i))
    want = []
    for i, _, t in rows:
        f = first.get(t)
        revisit = f is not None and i != f
        want.append((i, len((t or "").encode()), "revisit" if revisit else "response", f if revisit else None))
    assert got == sorted(want, key=str)
    read = warc.round_trip(spark.createDataFrame([(*r, "") for r in rows], PAGES))
    assert read.where("record_type = 'revisit'").count() > 0 and warc.unfit_revisits(read).count() == 0
    assert warc.unfit_revisits(read.where("record_type = 'revisit' or page_id <> 30")).count() == 1
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_with_many_shared_payloads(spark, monkeypatch):
    from loam.llm import shared

    monkeypatch.setattr(warc, "SHARED_DIGESTS", 0)
    monkeypatch.setattr(shared, "HOT", 3)
    rows = [(i, "u", ("same" if i % 3 else f"other {i // 6}") * 40, "") for i in range(60)] + [(100, None, "long " * 400_000, "")]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()}
    first = {}
    for i, _, html, _ in rows:
        first.setdefault(html, i)
    assert got == {i: ("response", None) if first[h] == i else ("revisit", first[h]) for i, _, h, _ in rows}


@given(st.lists(st.binary(max_size=300_000), max_size=4))
@settings(max_examples=25, deadline=None)
def test_records_round_trip(blocks):
    out = io.BytesIO()
    for i, b in enumerate(blocks):
        warc.write_record(out, {"WARC-Type": "resource", "WARC-Record-ID": f"<{i}>", "WARC-Block-Digest": warc.block_digest(b)}, b)
    assert [r.block for r in warc.read_records(io.BytesIO(out.getvalue()))] == blocks


def test_bad_archives_are_noticed():
    out = io.BytesIO()
    warc.write_record(out, {"WARC-Type": "resource", "WARC-Block-Digest": warc.block_digest(b"other")}, b"block")
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(out.getvalue())))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(out.getvalue()[:-12])))
