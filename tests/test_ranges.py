"""Archives by ranges: the same members as from whole cells, read by several tasks."""

import io
import pickle
import random
import warnings
import zipfile
from contextlib import contextmanager

import pandas as pd

from loam.sources import archives, ranges


def test_ranges_give_the_members_of_whole_archives(spark, tmp_path):
    rng = random.Random(0)
    many = {f"lib/x86/{i}.so": rng.randbytes(rng.randint(0, 3_000)) for i in range(200)} | {"readme.txt": b"not wanted", "a.dex": b""}
    contents = {
        "many.apk": archives.build_zip(many), "streamed.apk": archives.build_zip(many, streamed=True), "flagged.apk": archives.build_zip({"a.apk": b"x" * 500, "b.dex": b"y"}, encrypted_flag=True),
        "none.apk": archives.build_zip({"readme.txt": b"x"}), "empty.apk": b"", "cut.apk": archives.build_zip(many)[:-400], "text.apk": b"PK but no archive",
    }
    bad = bytearray(archives.build_zip({"a.dex": b"spoiled " * 100, "b.dex": b"fine"}, compress=False))
    bad[60] ^= 1
    contents["spoiled.apk"] = bytes(bad)
    paths = []
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
        paths.append(f"file://{tmp_path}/{name}")
    got = ranges.read_members(spark, paths, 20_000)
    assert got.rdd.getNumPartitions() > 2 * 200 * 1_500 // 20_000
    whole = spark.createDataFrame([(p, bytearray((tmp_path / p.rsplit("/", 1)[1]).read_bytes())) for p in paths], "id string, content binary")
    shaped = lambda df: sorted((r["id"], r["member"] or "", r["content"] and bytes(r["content"]), r["is_cut"], r["error"]) for r in df.collect())
    assert shaped(got) == shaped(archives.members(whole))
    one = next(p for p in ranges._Reader(paths, 20_000).partitions() if p.path == paths[0])
    assert 0 < len(one.names) < 30 and one.first


def _counted(monkeypatch):
    seen, opened = [], ranges._opened

    @contextmanager
    def counted(*args):
        with opened(*args) as archive:
            seen.append(len(archive.infolist()))
            yield archive

    monkeypatch.setattr(ranges, "_opened", counted)
    return seen


def test_a_task_reads_its_part_of_the_directory(tmp_path, monkeypatch):
    many = {f"{'é' * (i % 3)}{i}.dex": bytes([i % 250]) * (i % 40) for i in range(2_000)}
    (tmp_path / "many.zip").write_bytes(b"before the archive" + archives.build_zip(many))
    reader = ranges._Reader([f"{tmp_path}/many.zip"], 500)
    parts = reader.partitions()
    seen = _counted(monkeypatch)
    assert {r[1]: r[2] for p in parts for r in reader.read(p) if r[1]} == many
    assert len(parts) > 20 and sum(seen) < 2 * len(many) + 2 * len(parts)
    assert max(len(pickle.dumps(p)) for p in parts) < 500


def test_names_that_repeat_and_overlaps_are_as_in_whole_archives(tmp_path):
    out = io.BytesIO()
    with warnings.catch_warnings(), zipfile.ZipFile(out, "w") as archive:
        warnings.simplefilter("ignore")
        for i in range(30):
            archive.writestr(f"{i % 20}.dex", f"{i}" * 50)
    overlapping = bytearray(archives.build_zip({f"{i}.dex": b"x" * 90 for i in range(30)}, compress=False))
    at = overlapping.find(b"PK\x01\x02")
    for _ in range(30):
        # Sizes in the directory that run into the next member, or the directory.
        overlapping[at + 20 : at + 28] = (200).to_bytes(4, "little") * 2
        at = overlapping.find(b"PK\x01\x02", at + 4)
    for data in (out.getvalue(), bytes(overlapping)):
        (tmp_path / "odd.zip").write_bytes(data)
        reader = ranges._Reader([f"{tmp_path}/odd.zip"], 300)
        got = [r[1:] for p in reader.partitions() for r in reader.read(p)]
        assert got == [r[1:] for r in archives._rows([pd.DataFrame({"id": ["a"], "content": [data]})])]


def test_directories_beyond_four_gb(tmp_path):
    many = {f"{i}.dex": f"{i}".encode() * 9 for i in range(300)}
    with open(tmp_path / "far.zip", "w+b") as f:
        f.seek(5 << 30)  # a hole, which takes no disk
        with zipfile.ZipFile(f, "w") as archive:
            for name, data in many.items():
                archive.writestr(name, data)
    reader = ranges._Reader([f"{tmp_path}/far.zip"], 500)
    parts = reader.partitions()
    assert len(parts) > 5 and {r[1]: r[2] for p in parts for r in reader.read(p) if r[1]} == many
