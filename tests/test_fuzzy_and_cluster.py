import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.functions import fuzzy
from loam.operators import cluster, distance, evaluation, matrix, similar, spatial, sweep


def prose(seed, n=4000):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n // 6)).encode()


def test_ctph():
    a, b = prose(1), prose(2)
    near = a[:2000] + b"changed here" + a[2010:]
    x, y, z = map(fuzzy.ctph, (a, near, b))
    assert fuzzy.ctph_similarity(x, x) == 100 and fuzzy.ctph_similarity(x, y) == fuzzy.ctph_similarity(y, x) > 60
    assert fuzzy.ctph_similarity(x, z) == 0 and fuzzy.ctph(b"") == "3::" and fuzzy.ctph(None) is None
    assert set(fuzzy.ctph_grams(x)) & set(fuzzy.ctph_grams(y))


def test_tlsh():
    a, b = prose(1), prose(2)
    x, y, z = map(fuzzy.tlsh, (a, a[:1500] + b"word" + a[1500:], b))
    assert fuzzy.tlsh_distance(x, x) == 0
    assert fuzzy.tlsh_distance(x, y) == fuzzy.tlsh_distance(y, x) < fuzzy.tlsh_distance(x, z)
    assert fuzzy.tlsh(b"short") is None and fuzzy.tlsh(bytes(1000)) is None


def test_candidates_equal_all_pairs(spark):
    texts = [prose(i) for i in range(4)]
    texts += [t[:1000] + b"xyz" + t[1000:] for t in texts[:2]] + [texts[0], b"", b""]
    rows = spark.createDataFrame([(i, bytearray(t), "f") for i, t in enumerate(texts)], "node_id int, content binary, family string")
    got = {tuple(r) for r in distance.ssdeep_candidates(distance.features(rows)).collect()}
    hashes = [fuzzy.ctph(t) for t in texts]
    want = {(i, j, s) for i in range(len(texts)) for j in range(i + 1, len(texts)) if (s := fuzzy.ctph_similarity(hashes[i], hashes[j]))}
    assert got == want


def plain_tlsh_distance(x, y):
    """Byte by byte and code by code."""
    a, b = bytes.fromhex(x), bytes.fromhex(y)
    around = lambda p, q, n: min((p - q) % n, (q - p) % n)
    length = around(a[1], b[1], 256)
    total = int(a[0] != b[0]) + (length if length <= 1 else 12 * length)
    for p, q in ((a[2] >> 4, b[2] >> 4), (a[2] & 15, b[2] & 15)):
        d = around(p, q, 16)
        total += d if d <= 1 else 12 * (d - 1)
    for p, q in zip(a[3:], b[3:], strict=True):
        for k in (0, 2, 4, 6):
            d = abs((p >> k & 3) - (q >> k & 3))
            total += 6 if d == 3 else d
    return total


def digests_around(seed=0, centres=6, each=25):
    """Random digests with others a few steps away, so that distances spread around small bounds."""
    rng = random.Random(seed)
    out = []
    for _ in range(centres):
        centre = [rng.randrange(256) for _ in range(35)]
        for _ in range(each):
            d = list(centre)
            for _ in range(rng.randint(0, 30)):
                at, k = rng.randrange(3, 35), rng.choice((0, 2, 4, 6))
                code = min(3, max(0, (d[at] >> k & 3) + rng.choice((-1, 1))))
                d[at] = d[at] & ~(3 << k) | code << k
            d[1] = (d[1] + rng.choice((0, 0, 0, 1, 255, 2))) % 256
            d[0] = rng.choice((d[0], d[0], 7))
            out.append(bytes(d).hex())
    return out


@pytest.mark.parametrize("bound", [0, 5, 20, 33])
@pytest.mark.parametrize("hot", [1_024, 4])
def test_tlsh_pairs_within_a_bound_equal_all_pairs(spark, monkeypatch, bound, hot):
    monkeypatch.setattr(similar, "HOT", hot)
    digests = digests_around()
    rows = [(i, d) for i, d in enumerate(digests)] + [(1000 + i, digests[0]) for i in range(40)] + [(-5, digests[7]), (2000, None)]
    df = spark.createDataFrame(rows, "node_id long, tlsh string").repartition(3)
    first = {}
    for i, d in rows:
        first[d] = min(i, first.get(d, i))
    reps = sorted((i, d) for d, i in first.items() if d)
    want = {(i, j, n) for k, (i, x) in enumerate(reps) for j, y in reps[k + 1 :] if (n := plain_tlsh_distance(x, y)) <= bound}
    assert bound == 0 or len(want) > 10
    got = [tuple(r) for r in similar.tlsh_near(df, bound).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(r) for r in similar.membership(df, "tlsh").collect()} == {(i, first[d]) for i, d in rows if d}


def test_a_mirrored_matrix_reads_its_pairs_once(spark):
    made = spark.sparkContext.accumulator(0)

    def pairs(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    upper = spark.createDataFrame([(1, 2, 0.5), (1, 3, 2.0), (2, 3, 1.5)], "i long, j long, d double").mapInPandas(pairs, "i long, j long, d double")
    found = distance.mirrored(upper, spark.createDataFrame([(1,), (2,), (3,)], "node_id long"))
    want = {(1, 2, 0.5), (1, 3, 2.0), (2, 3, 1.5)}
    assert sorted(map(tuple, found.collect())) == sorted([*want, *((j, i, d) for i, j, d in want), (1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)])
    assert made.value == 3


def test_screened_pairs_hold_all_near_ones_and_few_others():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 64))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    x[1], x[2] = x[0], 1e6 * x[2]
    exact = distance._measured(x[:, None], x[None], ("euclidean",))["euclidean"]
    assert (exact[:4, :4] == exact[:4, :4].T).all() and exact[0, 1] == 0
    # Bounds that are the very distances of pairs, where rounding decides.
    for eps in (0.0, *exact[5, 6:30].tolist(), exact[2, 7]):
        a, b = distance._screened(x, x, eps)
        assert set(zip(*np.nonzero(exact <= eps), strict=True)) <= set(zip(a, b, strict=True))
    plain = np.delete(x, 2, axis=0)
    assert len(distance._screened(plain, plain, 1.16)[0]) < 300 * 20
    x[3, 5] = np.nan
    a, b = distance._screened(x, x, 1.0)
    assert {(0, 1), (7, 7)} <= set(zip(a.tolist(), b.tolist(), strict=True))


def test_piecewise_hash_and_its_distance_equal_plain_ones():
    rng = random.Random(5)

    def piece(data):
        h = 0x28021967
        for c in data:
            h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
        return fuzzy._ALPHABET[h & 63]

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + 2 * (x != y))
        return row[-1]

    for n in (0, 1, 2, 7, 60, 400, 3000):
        data = bytes(rng.randrange(256) for _ in range(n))
        block, first, _ = fuzzy.ctph(data).split(":")
        ends = (np.flatnonzero(fuzzy._rolling(data) % np.uint64(int(block)) == int(block) - 1)[:63] + 1).tolist()
        starts = [0, *ends]
        assert first == "".join(piece(data[a:b]) for a, b in zip(starts, [*ends, n], strict=True) if b > a)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcdX/") for _ in range(rng.randint(0, 64))) for _ in "ab")
        assert fuzzy._edit_distance(a, b) == apart(a, b)


def test_similarity_by_representatives_says_all(spark, tmp_path):
    """One row for each further copy, however many pairs the copies of two near texts make."""
    from loam import registry

    one, words = prose(1).decode(), prose(1).decode().split()
    two = " ".join([*words[:-3], "other", "end"])
    texts = [one] * 6 + [two] * 5 + [prose(9).decode()]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {tuple(r) for r in registry.queries()["ctph_similarity"](spark, str(tmp_path)).select("i", "j", "similarity").collect()}
    near = fuzzy.ctph_similarity(fuzzy.ctph(one.encode()), fuzzy.ctph(two.encode()))
    assert near and found == {(0, 6, near), *((0, j, 100) for j in range(1, 6)), *((6, j, 100) for j in range(7, 11))}


def test_copies_of_the_piecewise_hash(spark):
    data = [(1, "3:abcdefgh:x"), (2, "3:abcdefgh:x"), (3, "3:abcdefgz:x"), (4, None), (5, "3:abcdefgh:x")]
    found = distance.ssdeep_copies(spark.createDataFrame(data, "node_id long, ssdeep string"))
    assert {tuple(r) for r in found.collect()} == {(1, 2, 100), (1, 5, 100), (2, 5, 100)}


def test_far_candidates_are_dropped_where_they_meet(spark):
    digests = fuzzy.tlsh_digests(digests_around(3))
    planes, apart = fuzzy.tlsh_planes(digests).view(np.uint64), {}
    for i in range(len(digests)):
        for j in range(i + 1, len(digests)):
            codes = sum(int(np.bitwise_count((planes[i, k] ^ planes[j, k]) | (planes[i, k + 2] ^ planes[j, k + 2]))) for k in (0, 1))
            assert codes <= fuzzy.tlsh_distances(digests[i : i + 1], digests[j : j + 1])[0]
            apart[i, j] = codes
    names = ["a", "b", "c", "d"]
    figures = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(planes.view(np.int64))], "node_id long, " + ", ".join(f"{n} long" for n in names))
    keyed = figures.selectExpr("node_id", "0L as key")
    found = similar.key_pairs(keyed, figures, lambda x, y: fuzzy.tlsh_codes_apart(x, y) <= 20)
    assert {tuple(r) for r in found.collect()} == {p for p, codes in apart.items() if codes <= 20}


def test_no_task_gets_all_copies(spark, monkeypatch):
    """Of 20,000 nodes of one hash, no piece of the join has more than a few thousand."""
    df = spark.range(20_000).select(F.col("id").alias("node_id"), F.lit("3:abcdefghij:klmnop").alias("ssdeep"))
    members = similar.membership(df, "ssdeep")
    assert members.where("rep = 0").count() == 20_000
    assert similar.ctph_near(df).count() == 0


def direct(matrix, eps, k):
    n = len(matrix)
    near = matrix <= eps
    core = near.sum(axis=1) >= k
    labels, number = np.zeros(n, int), 0
    for s in range(n):
        if core[s] and not labels[s]:
            number += 1
            todo = [s]
            while todo:
                p = todo.pop()
                if not labels[p]:
                    labels[p] = number
                    todo += [q for q in np.flatnonzero(near[p] & core) if not labels[q]]
    for p in range(n):
        beside = [labels[q] for q in np.flatnonzero(near[p] & core)]
        if not core[p] and beside:
            labels[p] = min(beside)
    return labels


def matrix_of(seed, n=40):
    x = np.random.default_rng(seed).normal(size=(n, 2))
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def direct_sweep(spark, matrix, families, eps_values, min_pts_values):
    """The measures of every cell from labels found anew."""
    counts = []
    for k in min_pts_values:
        for eps in eps_values:
            labels = direct(matrix, eps, k)
            pairs, n = np.unique(np.column_stack([labels, families]), axis=0, return_counts=True)
            counts += [(float(eps), k, int(c), str(f), int(m), int(labels.max()) + 1) for (c, f), m in zip(pairs, n, strict=True)]
    rows = spark.createDataFrame(counts, "eps double, min_pts int, cluster long, label string, cnt long, buckets long")
    by = ("eps", "min_pts")
    return evaluation.measures(evaluation.parts(rows, by, buckets="buckets"), by)


def swept(spark, matrix, families, eps_values, min_pts_values, **options):
    n = len(matrix)
    # Ids with gaps and below zero.
    ids = [7 * i - 50 for i in range(n)]
    pairs = [(ids[i], ids[j], float(matrix[i, j])) for i in range(n) for j in range(i + 1, n)]
    nodes = spark.createDataFrame([(i, str(f)) for i, f in zip(ids, families, strict=True)], "node_id long, family string")
    return sweep.dbscan_grid(spark, spark.createDataFrame(pairs, "i long, j long, d double").repartition(3), nodes, ["d"], eps_values, min_pts_values, **options)


def same_cells(got, want):
    by, numbers = ["min_pts", "eps"], ["n", "purity", "nmi", "ri_ref", "ri_std", "f5_ref", "f5_std"]
    a, b = (x.toPandas().sort_values(by).reset_index(drop=True) for x in (got, want))
    assert (a[by].astype(float) == b[by].astype(float)).all(axis=None)
    np.testing.assert_allclose(a[numbers].astype(float), b[numbers].astype(float), atol=1e-9, equal_nan=True)


def test_all_cells_of_the_grid_equal_direct_search(spark):
    m = (40 * matrix_of(1, 26)).round()
    m[:, 5], m[5, :] = m[:, 4], m[4, :]  # a copy
    m[5, 5] = m[4, 5] = m[5, 4] = 0
    families = np.random.default_rng(1).integers(0, 4, 26)
    eps, pts = list(range(1, 100)), list(range(2, 100))
    got = swept(spark, m, families, eps, pts)
    assert got.count() == 9_702
    same_cells(got, direct_sweep(spark, m, families, eps, pts))


@pytest.mark.parametrize("seed", range(3))
def test_sweep_in_many_blocks_equals_direct_search(spark, monkeypatch, seed):
    monkeypatch.setattr(sweep, "BLOCK", 5)
    monkeypatch.setattr(sweep, "FAN", 3)
    m = matrix_of(seed, 45).round(1)
    families = np.arange(45) % (1 + seed * 20)
    eps, pts = [0.0, 0.1, 0.25, 0.3, 0.5, 1, 2, 9], [1, 2, 3, 5, 9, 60]
    same_cells(swept(spark, m, families, eps, pts), direct_sweep(spark, m, families, eps, pts))


@pytest.mark.parametrize("block", [7, 512])
def test_sweep_of_points_equals_direct_search_and_writes_no_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(distance, "BLOCK", block)
    x = np.random.default_rng(6).normal(size=(70, 2)).round(1)
    m = distance._measured(x[:, None], x[None], ("euclidean",))["euclidean"]
    families = ["a", "b", "d"] * 23 + ["c"]
    nodes = spark.createDataFrame(list(enumerate(families)), "node_id long, family string")
    points = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "node_id long, value array<double>")
    names = []
    monkeypatch.setattr(sweep, "spool", lambda df, name, spool=sweep.spool: names.append(name) or spool(df, name))
    got = sweep.dbscan_grid_of_points(points, nodes, "d", 1.2, lambda d: 2 * d, [0.2, 0.6, 1.0, 2.0], [1, 2, 4, 9])
    want = direct_sweep(spark, 2 * m, families, [0.2, 0.6, 1.0, 2.0], [1, 2, 4, 9])
    same_cells(got, want)
    assert "edges" not in names


def test_sweep_of_matrix_rows(spark, monkeypatch):
    monkeypatch.setattr(sweep, "BLOCK", 7)
    m = matrix_of(5, 30).round(1)
    rows = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    families = np.arange(30) % 3
    eps, pts = [0.3, 0.9, 1.5, 2.5, 4], [2, 4, 31]
    same_cells(swept(spark, m, families, eps, pts, rows_as_points=True), direct_sweep(spark, rows, families, eps, pts))


@pytest.mark.parametrize("screen", [3, 1_024])
def test_near_rows_of_the_distance_matrix(spark, monkeypatch, screen):
    for name, size in (("SCREEN", screen), ("CHUNK", 9), ("PAIRS", 5), ("ROWS", 4)):
        monkeypatch.setattr(matrix, name, size)
    monkeypatch.setattr(distance, "BLOCK", 8)
    x = np.random.default_rng(3).normal(size=(40, 3))
    x[30:] = x[:10] + 0.01
    x[39] = x[0]
    m = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    rows = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    points = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "node_id long, value array<double>")
    written = []
    monkeypatch.setattr(matrix, "spool", lambda df, name, spool=matrix.spool: written.append(spool(df, name)) or written[-1])
    got = {(r["i"], r["j"]): r["d"] for r in matrix.near_rows(points, 1.0).collect()}
    assert set(got) == {(i, j) for i in range(40) for j in range(i + 1, 40) if rows[i, j] <= 1.0}
    assert all(abs(d - rows[k]) < 1e-9 for k, d in got.items()) and got[0, 39] == 0
    # Neither a row nor a cell for each pair of points is written.
    assert sum(f.count() for f in written) < 40
    assert matrix.near_rows(points.limit(0), 1.0).count() == 0 == matrix.near_rows(points.limit(1), 1.0).count()


def test_sweep_of_little(spark):
    nodes = spark.createDataFrame([(1, "a")], "node_id long, family string")
    none = spark.createDataFrame([], "i long, j long, d double")
    assert sweep.dbscan_grid(spark, none, nodes, ["d"], [1, 2], [2]).select("n", "purity").collect() == [(1, 1.0)] * 2
    assert sweep.dbscan_grid(spark, none, nodes.limit(0), ["d"], [1, 2], [2]).count() == 0
    apart = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "node_id long, family string")
    null = spark.createDataFrame([(1, 2, None), (1, 3, 1.0)], "i long, j long, d double")
    got = sweep.dbscan_grid(spark, null, apart, ["d"], [1], [2]).first()
    assert got["n"] == 3 and got["purity"] == 1.0


def test_relational_dbscan_equals_direct_search(spark):
    m = matrix_of(9)
    pairs = [(i, j, float(m[i, j])) for i in range(40) for j in range(i + 1, 40)]
    got = cluster.dbscan(spark.range(40).withColumnRenamed("id", "node_id"), spark.createDataFrame(pairs, "i long, j long, d double"), 0.4, 4).orderBy("node_id").collect()
    assert [r["cluster"] for r in got] == direct(m, 0.4, 4).tolist()


@pytest.mark.parametrize("cell", [6, 4_096])
@pytest.mark.parametrize("eps, min_pts", [(0.35, 4), (0.1, 2), (1.5, 30)])
def test_dbscan_by_cells_equals_direct_search(spark, monkeypatch, cell, eps, min_pts):
    """Skewed and repeated points, cells cut several times, cells that can't be cut."""
    monkeypatch.setattr(spatial, "CELL", cell)
    monkeypatch.setattr(spatial, "FAN", 4)
    monkeypatch.setattr(similar, "HOT", 16)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(60, 2)), rng.normal(scale=0.05, size=(40, 2)) + 3, np.repeat([[0.5, 0.5]], 50, axis=0), [[9.0, 9.0], [-0.0, 0.0], [0.0, 0.0]]]).round(2)
    m = np.sqrt((x[:, 0, None] - x[None, :, 0]) ** 2 + (x[:, 1, None] - x[None, :, 1]) ** 2)
    rows = [(3 * i - 70, [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (10_000, None), (10_001, [1.0, None]), (10_002, [float("nan"), 0.0])], "node_id long, value array<double>").repartition(3)
    got = spatial.dbscan_points(df, eps, min_pts).orderBy("node_id").collect()
    assert [r["cluster"] for r in got] == [*direct(m, eps, min_pts).tolist(), 0, 0, 0]
    assert [r["core"] for r in got] == [*((m <= eps).sum(axis=1) >= min_pts).tolist(), False, False, False]
    if cell == 6 and eps == 0.1:
        dealt = spatial.cells(df.where("node_id < 10000").groupBy("value").agg(F.min("node_id").alias("point"), F.count("*").alias("weight")), eps)
        if dealt is not None:
            assert dealt.groupBy("cell").count().agg(F.max("count")).first()[0] <= 6 and dealt.where("own").count() == len({tuple(v) for v in x + 0.0})


@pytest.mark.parametrize("block", [9, 512])
@pytest.mark.parametrize("eps, min_pts", [(0.35, 4), (0.1, 2), (1.5, 30), (0.4, 9)])
def test_dbscan_and_votes_by_blocks_equal_direct_search(spark, monkeypatch, block, eps, min_pts):
    monkeypatch.setattr(distance, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(60, 2)), rng.normal(scale=0.05, size=(40, 2)) + 3, np.repeat([[0.5, 0.5]], 20, axis=0), [[9.0, 9.0], [-0.0, 0.0], [0.0, 0.0]]]).round(2)
    m = np.sqrt((x[:, 0, None] - x[None, :, 0]) ** 2 + (x[:, 1, None] - x[None, :, 1]) ** 2)
    rows = [(3 * i - 70, [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (10_000, None), (10_001, [1.0, None])], "node_id long, value array<double>").repartition(3)
    labels = direct(m, eps, min_pts)
    got = spatial.dbscan_blocks(df, eps, min_pts).orderBy("node_id").collect()
    assert [r["cluster"] for r in got] == [*labels.tolist(), 0, 0]
    assert [r["core"] for r in got] == [*((m <= eps).sum(axis=1) >= min_pts).tolist(), False, False]
    votes = [np.bincount(labels[near]).argmax() for near in m <= eps]
    assert [r["cluster"] for r in spatial.voted_blocks(df, eps, min_pts).orderBy("node_id").collect()] == [*votes, 0, 0]


@pytest.mark.parametrize("name", ["dbscan_labels", "dbscan_by_cells", "dbscan_vote"])
def test_clusters_without_rows_for_pairs(spark, tmp_path, monkeypatch, name):
    """Nothing that is written grows with the pairs that are close: here all of 150 points."""
    from loam import registry
    from loam.operators import blocked

    rng = np.random.default_rng(1)
    rows = [(i, [float(a) for a in v], 0) for i, v in enumerate(rng.normal(scale=0.001, size=(150, 8)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sizes = []

    def counted(df, name):
        df = spool(df, name)
        sizes.append(df.count())
        return df

    from loam.storage import spool

    for module in (blocked, cluster, distance, registry, spatial):
        if hasattr(module, "spool"):
            monkeypatch.setattr(module, "spool", counted)
    monkeypatch.setattr(spatial, "CELL", 10)
    assert registry.queries()[name](spark, str(tmp_path)).groupBy("cluster").count().collect() == [(1, 150)]
    assert max(sizes) < 150 * 20


def test_dbscan_of_no_points(spark):
    assert spatial.dbscan_points(spark.createDataFrame([], "node_id long, value array<double>"), 1.0, 2).count() == 0


def test_numbers(spark):
    values = spark.createDataFrame([(i * 3,) for i in range(50)], "root long").repartition(4)
    assert {tuple(r) for r in cluster.numbered(values, "root").collect()} == {(i * 3, i + 1) for i in range(50)}


def test_sweep_and_csv(spark, tmp_path):
    from loam.sources.files import write_sweep_csv

    m = matrix_of(3, 20)
    pairs = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(20) for j in range(i + 1, 20)], "i long, j long, d double")
    families = spark.range(20).select(F.col("id").alias("node_id"), (F.col("id") % 3).cast("string").alias("family"))
    got = sweep.dbscan_grid(spark, pairs, families, ["d"], [1, 2], [2, 3, 4])
    assert got.count() == 6
    write_sweep_csv(got, str(tmp_path))
    back = spark.read.option("header", True).csv(f"{tmp_path}/dbscan_d.csv")
    assert back.columns == ["eps", "min_pts", "prurity", "nmi", "ri", "f5"] and back.count() == 6


def test_distances(spark):
    rows = spark.createDataFrame([(1, [0.0, 3.0]), (2, [4.0, 0.0])], "node_id int, value array<double>")
    got = distance.pairs(rows, {"e": distance.euclidean, "m": distance.manhattan, "c": distance.cosine_distance}).first()
    assert (got["e"], got["m"], got["c"]) == (5.0, 7.0, 1.0)
    full = distance.mirrored(distance.pairs(rows, {"d": distance.euclidean}), rows)
    assert sorted(tuple(r) for r in full.collect()) == [(1, 1, 0.0), (1, 2, 5.0), (2, 1, 5.0), (2, 2, 0.0)]


@pytest.mark.parametrize("block", [4, 512])
def test_near_pairs_equal_all_pairs(spark, monkeypatch, block):

    from loam.operators import distance

    monkeypatch.setattr(distance, "BLOCK", block)
    rng = np.random.default_rng(0)
    points = {i: [float(x) for x in rng.normal(size=3)] for i in range(60)} | {100: [50.0, 0.0, 0.0], 101: [50.0, 0.0, 0.5]}
    df = spark.createDataFrame(list(points.items()), "node_id long, value array<double>")
    for eps in (0.0, 0.7, float("inf")):
        got = {(r["i"], r["j"]): r["d"] for r in distance.within(df, eps).collect()}
        want = {(i, j): float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())) for i, a in points.items() for j, b in points.items() if i < j}
        want = {k: d for k, d in want.items() if d <= eps}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert distance.within(df.limit(0), 1.0).count() == 0


@pytest.mark.parametrize("one_task", [0, 10_000])
def test_components_either_way(spark, monkeypatch, one_task):
    from loam.operators import cluster, union

    monkeypatch.setattr(union, "ONE_TASK", one_task)
    links = [(1, 2), (2, 3), (5, 9), (9, 12), (12, 5)]
    both = spark.createDataFrame(links + [(b, a) for a, b in links], "i long, j long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 9, 12)], "node_id long")
    assert {tuple(r) for r in cluster.components(nodes, both).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (9, 5), (12, 5)}


def test_ctph_similarities_of_many_are_those_of_each(monkeypatch):
    rng = random.Random(5)
    pieces = ["".join(rng.choice("abcdef") for _ in range(12)) for _ in range(6)]
    signature = lambda most: "".join(rng.choice((*pieces, "xyz", "q" * 5)) for _ in range(6))[: rng.randint(0, most)]
    hashes = [f"{rng.choice((3, 6, 12, 192))}:{signature(64)}:{signature(32)}" for _ in range(70)]
    hashes += ["6:AAAAAAA:BBB", "3:AAAB:", "3:AAAAB:", "12:" + "abcdefghijklmnop" * 4 + ":x", fuzzy.ctph(b""), None]
    pairs = [(x, y) for x in hashes for y in hashes]
    want = [fuzzy.ctph_similarity(x, y) for x, y in pairs]
    assert len(set(want)) > 15
    called = []
    monkeypatch.setattr(fuzzy, "ctph_similarity", lambda *xy, f=fuzzy.ctph_similarity: called.append(xy) or f(*xy))
    assert fuzzy.ctph_similarities(*map(list, zip(*pairs, strict=True))) == want and not called
    odd = ["3:" + "é" * 9 + ":", "3:" + "abcdefghij" * 9 + ":abc"]
    assert fuzzy.ctph_similarities(odd, odd) == [100, 100] and fuzzy.ctph_similarities([], []) == []
