import random

import pytest
from pyspark.sql import functions as F

from loam import schema
from loam.operators import ancestry, graph
from loam.operators.graph import GraphStore


def test_first_writer_wins_and_a_second_upsert_changes_nothing(spark):
    stored = spark.createDataFrame([("C", "a", 1)], "collection string, _key string, x int")
    batch = spark.createDataFrame([("C", "a", 9), ("C", "b", 5), ("C", "b", 3), ("D", "a", 7)], stored.schema)
    once = graph.upsert(stored, batch, ["collection", "_key"], ["x"])
    assert {tuple(r) for r in once.collect()} == {("C", "a", 1, False), ("C", "b", 3, True), ("D", "a", 7, True)}
    twice = graph.upsert(once.drop("created"), batch, ["collection", "_key"], ["x"])
    assert {tuple(r)[:3] for r in twice.collect()} == {tuple(r)[:3] for r in once.collect()}
    assert twice.where("created").count() == 0
    result = graph.upsert_result(stored, batch, ["collection", "_key"])
    assert result.where("_key = 'a' and collection = 'C'").first()["created"] is False


def test_edge_keys(spark):
    rows = spark.createDataFrame([("A/1", "B/x/2")], "f string, t string")
    assert rows.select(graph.edge_key("f", "t").alias("k")).first()["k"] == "A-1--B-x-2"


def test_lookup(spark):
    rows = spark.createDataFrame([(2, "x"), (1, "x")], "id int, k string")
    assert graph.get_document(rows, "k", "x", order="id").first()["id"] == 1
    assert graph.find_document(rows, "k", "x")["k"] == "x"
    with pytest.raises(LookupError):
        graph.find_document(rows, "k", "nothing")


def test_violations(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "k string")
    assert [tuple(r) for r in graph.unique_violations(rows, ["k"]).collect()] == [("a", 2)]
    vertices = spark.createDataFrame([("Coper", "Coper"), ("CoperAPK", "1")], "collection string, _key string")
    links = spark.createDataFrame(
        [("CoperHasAPK", "Coper/Coper", "CoperAPK/1"), ("CoperHasAPK", "CoperAPK/1", "Coper/Coper"), ("CoperHasAPK", "Coper/Coper", "CoperAPK/2")],
        "collection string, _from string, _to string",
    )
    got = graph.domain_violations(links, vertices, graph.edge_definitions(spark)).select("_from", "_to", "reason").collect()
    assert {tuple(r) for r in got} == {("CoperAPK/1", "Coper/Coper", "definition"), ("Coper/Coper", "CoperAPK/2", "_to")}


def test_closure_ends_on_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "parent int, child int")
    got = {tuple(r) for r in graph.closure(links, 8).collect()}
    assert (1, 4, 3) in got and (1, 1, 3) in got and len(got) == 12
    assert {tuple(r) for r in graph.closure(links).collect()} == got
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "parent int, child int")
    assert graph.closure(chain).where("ancestor = 0").count() == 12 and graph.closure(chain, 3).agg(F.max("depth")).first()[0] == 3


def test_store_init_is_idempotent(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g")
    for _ in range(2):
        store.init("FocusedCorpus", ("Coper",))
    assert store.vertices.count() == 2 and store.edges.count() == 1
    assert store.edges.first()["_key"] == "FocusedCorpus-FocusedCorpus--Coper-Coper"
    assert set(store.vertices.columns) == set(schema.VERTICES.fieldNames())
    assert store.vertices.where(F.col("attrs")["name"] == "Coper").count() == 1


def rows_of(spark, rows):
    return spark.createDataFrame([(c, k, {}) for c, k in rows], schema.VERTICES if all(k for _, k in rows) else "collection string, _key string, attrs map<string,string>")


def test_store_appends_what_is_new_and_compacts(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g")
    store.upsert(rows_of(spark, [("A", "1"), ("B", "1")]))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    store.upsert(rows_of(spark, [("A", "1"), ("A", "2"), ("A", "2")]))
    assert {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet") if p in before} == before
    assert {(r["collection"], r["_key"]) for r in store.vertices.collect()} == {("A", "1"), ("B", "1"), ("A", "2")} and store.vertices.count() == 3
    assert len(store._versions("vertices")) == 2
    (tmp_path / "g" / "vertices" / "version=00000009-half").mkdir()
    assert len(store._versions("vertices")) == 2, "a version without its mark doesn't count"
    store.compact()
    assert len(store._versions("vertices")) == 1 and store.vertices.count() == 3
    store.upsert(rows_of(spark, [("A", "3")]))
    assert store.vertices.count() == 4
    assert store.vertices.where("collection = 'A'").count() == 3


def test_store_constraints(spark, tmp_path):
    store = GraphStore.open(spark, f"file://{tmp_path}/w", "focused")
    assert store.folder.endswith("/focused_corpus/focused_corpus_graph")
    kinds = store.collections()
    assert kinds["CoperDEX"] == "document" and kinds["CoperHasDEX"] == "edge" and kinds["CoperDEX--sha256sum"] == "index" and kinds["Coper--name"] == "index"
    assert store.ensure_collection("Own", fields=("a", "b")) == "Own--a-b" == store.ensure_collection("Own", fields=("a", "b"))
    with pytest.raises(graph.ConstraintError, match="Other/1: collection"):
        store.upsert(rows_of(spark, [("Other", "1")]))
    with pytest.raises(graph.ConstraintError, match="key"):
        store.upsert(rows_of(spark, [("Own", None)]))
    link = graph.edges(spark.range(1), "CoperHasDEX", F.lit("CoperDEX/1"), F.lit("CoperAPK/2"))
    with pytest.raises(graph.ConstraintError, match="definition"):
        store.upsert(rows_of(spark, [("Own", "1")]), link)
    assert store.vertices.count() == store.edges.count() == 0
    store.upsert(rows_of(spark, [("Own", "1")]), graph.edges(spark.range(2), "CoperHasDEX", F.lit("CoperAPK/1"), F.concat(F.lit("CoperDEX/"), F.col("id").cast("string"))))
    assert store.vertices.count() == 1 and store.edges.count() == 2
    again = GraphStore.open(spark, f"file://{tmp_path}/w", "focused")
    assert again.collections() == store.collections() and again.edges.count() == 2


def plain_closure(links):
    below, out = {}, {}
    for p, c in links:
        below.setdefault(p, set()).add(c)
    for a in below:
        seen, level, d = {}, set(below[a]), 1
        while level:
            seen |= {x: d for x in level if x not in seen}
            level, d = {y for x in level for y in below.get(x, ()) if y not in seen}, d + 1
        out |= {(a, x): n for x, n in seen.items()}
    return out


def test_closure_doubles(spark, monkeypatch):
    chain = [(i, i + 1) for i in range(700)]
    rounds = []
    monkeypatch.setattr(graph, "spool", lambda df, name, spool=graph.spool: rounds.append(name) or spool(df, name))
    got = graph.closure(spark.createDataFrame(chain, "parent long, child long"))
    assert len(rounds) <= 11 and got.count() == 701 * 700 // 2 and got.where("depth <> descendant - ancestor").count() == 0
    rng = random.Random(0)
    links = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)]
    for depth in (None, 1, 3, 4):
        want = {(a, d, n) for (a, d), n in plain_closure(links).items() if depth is None or n <= depth}
        assert {tuple(r) for r in graph.closure(spark.createDataFrame(links, "parent long, child long"), depth).collect()} == want


@pytest.mark.parametrize("extra", [0, 25])
def test_labels_tell_ancestors(spark, extra):
    """A forest with two roots, alone and with links to second parents."""
    rng = random.Random(extra)
    links = {(rng.randrange(max(0, i - 9), i), i) for i in range(1, 90) if i != 50}
    links |= {tuple(sorted(rng.sample(range(90), 2))) for _ in range(extra)}
    found = ancestry.label(spark.createDataFrame(sorted(links), "parent long, child long"))
    asked = spark.range(90).select(F.col("id").alias("ancestor")).crossJoin(spark.range(91).select(F.col("id").alias("descendant")))
    got = [tuple(r) for r in found.related(asked).collect()]
    assert len(got) == len(set(got)) and set(got) == set(plain_closure(links))


def test_labels_of_a_long_chain(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(ancestry, "spool", lambda df, name, spool=ancestry.spool: rounds.append(name) or spool(df, name))
    found = ancestry.label(spark.range(10_000).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child")))
    assert max(map(rounds.count, ("tour", "gates"))) <= 20
    asked = spark.createDataFrame([(0, 10_000), (10_000, 0), (17, 9_000), (5, 5)], "ancestor long, descendant long")
    assert {tuple(r) for r in found.related(asked).collect()} == {(0, 10_000), (17, 9_000)}


def test_labels_refuse_a_cycle(spark):
    with pytest.raises(ValueError, match="cycle"):
        ancestry.label(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "parent long, child long"))


def test_no_row_counts_twice_between_the_steps_of_compact(spark, tmp_path, monkeypatch):
    store = graph.GraphStore(spark, f"file://{tmp_path}/store")
    row = lambda k: spark.createDataFrame([("A", k, {"x": "y"})], "collection string, _key string, attrs map<string,string>")
    for k in ("1", "2", "3"):
        store.upsert(vertices=row(k))
    with monkeypatch.context() as m:
        m.setattr(store, "_delete", lambda path: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.compact()
    assert store.vertices.count() == 3
    store.upsert(vertices=row("3").unionByName(row("4")))
    assert sorted(r["_key"] for r in store.vertices.collect()) == ["1", "2", "3", "4"]
    store.compact()
    assert store.vertices.count() == 4 and len(store._versions("vertices")) == 1


def test_an_upsert_reads_the_buckets_of_its_keys_only(spark, tmp_path):
    store = graph.GraphStore(spark, f"file://{tmp_path}/store")
    rows = lambda keys, c="A": spark.createDataFrame([(c, str(k), {"x": "y"}) for k in keys], schema.VERTICES)
    for k in range(3):
        store.upsert(vertices=rows(range(100 * k, 100 * k + 120)))
    store.upsert(vertices=rows(range(50), "B"))
    assert store.vertices.count() == 370
    for keys in ([5], [7, 311, 9_999], list(range(12))):
        wanted = rows(keys)
        buckets = {r[0] for r in wanted.select(graph._bucket()).distinct().collect()}
        found = store.touched("vertices", wanted)
        files = {r[0] for r in found.select(F.input_file_name()).distinct().collect()}
        assert files and all("/collection=A/" in f and int(f.split("/bucket=")[1].split("/")[0]) in buckets for f in files)
        assert "bucket" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("PushedFilters")[0]
        assert {r["_key"] for r in found.collect()} >= {str(k) for k in keys if k < 9_999}
    store.upsert(vertices=rows([5, 311, 9_999]))
    assert store.vertices.count() == 371 and store.vertices.groupBy("collection", "_key").count().where("count > 1").count() == 0


def test_asked_pairs_are_no_rows_for_each_way_up(spark, monkeypatch):
    """Nodes of many gates with many parents each: what doesn't lead to a node is dropped where it meets the node's gate."""
    monkeypatch.setattr(ancestry, "HEADS", 3)
    links = {(p, c) for c in range(2, 60) for k in (2, 3, 4, 5) if (p := c // k) < c}
    found = ancestry.label(spark.createDataFrame(sorted(links), "parent long, child long"))
    asked = spark.range(60).select(F.col("id").alias("ancestor")).crossJoin(spark.range(60).select(F.col("id").alias("descendant")))
    got = found.related(asked)
    # The filter is part of the join, no list of ways is.
    assert "exists(heads" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(plain_closure(sorted(links)))
