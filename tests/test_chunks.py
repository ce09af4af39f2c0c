"""Chunk store: exact round trips, boundaries that stay where content is the same, each chunk once."""

import random

import pytest
from pyspark.sql import functions as F

from loam.operators import chunks


def noise(seed, n):
    return random.Random(seed).randbytes(n)


def pieces(data):
    ends = chunks.boundaries(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5_000, 60_000])
def test_boundaries_cover_the_content(n):
    for data in (noise(n, n), b"\0" * n, b"ab" * (n // 2)):
        found = pieces(data)
        assert b"".join(found) == data and all(chunks.LEAST <= len(p) <= chunks.MOST for p in found[:-1])


def test_boundaries_do_not_depend_on_the_step(monkeypatch):
    data = noise(7, 50_000)
    whole = chunks.boundaries(data)
    monkeypatch.setattr(chunks, "_STEP", 1_000)
    assert chunks.boundaries(data) == whole and 50 < len(whole) < 200


def test_an_insertion_changes_chunks_beside_it_only():
    data = noise(3, 40_000)
    before, after = set(pieces(data)), set(pieces(data[:20_000] + b"inserted" + data[20_000:]))
    assert len(before - after) <= 4 and len(before & after) > 40


def test_store_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    shared = noise(1, 20_000)
    rows = [(1, shared), (2, noise(2, 300) + shared), (3, shared), (4, b""), (5, None), (6, noise(6, 100)), (7, b"\0" * 30_000)]
    rows += [(100 + i, b"the same") for i in range(3_000)]
    df = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in rows], "id long, content binary")
    chunks.add(df.where("id % 2 = 1"), folder)
    chunks.add(df, folder)
    chunks.add(df.withColumn("content", F.lit(b"other")), folder)
    got = {r["id"]: bytes(r["content"]) for r in chunks.rebuilt(spark, folder).collect()}
    assert got == {i: c or b"" for i, c in rows}
    stored = chunks.chunks(spark, folder)
    assert stored.count() == stored.select("digest").distinct().count()
    figures = chunks.sharing(spark, folder).first()
    assert figures["samples"] == len(rows) and figures["shared"] > 20
    assert figures["bytes"] == sum(len(c or b"") for _, c in rows) and figures["stored_bytes"] < figures["bytes"] / 1.5
