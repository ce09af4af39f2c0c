import base64
import hashlib

import pytest

from loam.functions import codec
from loam.operators import graph
from loam.operators.graph import GraphStore
from loam.plans import families
from loam.sources import archives

ELF = b"\x7fELF\1\1" + bytes(12) + b"\x28\0"
DEX = b"dex\n035\0rest"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def files(spark, contents):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in contents.items()], "path string, content binary")


def keys(frame):
    return {(r["collection"], r["_key"]) for r in frame.collect()}


def links(frame):
    return {(r["collection"], r["_from"], r["_to"]) for r in frame.collect()}


def test_batch_chain(spark):
    python = b"print('inert')"
    shell = f"base64.b64decode('''{base64.b64encode(python).decode()}''')".encode()
    batch = b"powershell -WindowStyle Hidden -e " + base64.b64encode(shell) + b"\r\n"
    broken = b"powershell -WindowStyle Hidden -e nothing"
    got = families.carnavalheist(files(spark, {"a": batch, "b": broken, "c": b"import pickle", "d": b"?"}))
    assert {("CarnavalheistBatch", sha(batch)), ("CarnavalheistPs", sha(shell)), ("CarnavalheistPython", sha(python)), ("CarnavalheistBatch", sha(broken)), ("CarnavalheistPython", sha(b"import pickle"))} <= keys(got.vertices)
    assert ("CarnavalheistHasPython", f"CarnavalheistPs/{sha(shell)}", f"CarnavalheistPython/{sha(python)}") in links(got.edges)
    assert ("CarnavalheistHasBatch", "Carnavalheist/Carnavalheist", f"CarnavalheistBatch/{sha(broken)}") in links(got.edges)
    assert {(r["path"], r["stage"]) for r in got.errors.collect()} == {("b", "batch"), ("d", "classify")}


def test_script_chain(spark):
    inner = "$executioncontext; rest"
    xor = ('function dec {param($a) } $k = ("abcdefghijkl"); dec "' + codec.xor_gzip("abcdefghijkl", inner) + '"').encode()
    cert = "MIIE" + base64.b64encode(b"inert certificate").decode()
    cert = cert[: len(cert) // 4 * 4]
    code = "using System; inert"
    two = f"@({','.join(str(ord(c)) for c in cert)}) @({','.join(f'{ord(c)}+0' for c in code)}) @(65)".encode()
    got = families.mintsloader(files(spark, {"x": xor, "t": two, "bad": b'function f {param($a) } ("abcdefghijkl") f "QUJD"'}))
    assert {("MintsloaderPs", sha(xor)), ("MintsloaderPs", sha(inner)), ("MintsloaderPs", sha(two)), ("MintsloaderCS", sha(code))} <= keys(got.vertices)
    assert ("MintsloaderHasPs", f"MintsloaderPs/{sha(xor)}", f"MintsloaderPs/{sha(inner)}") in links(got.edges)
    assert ("MintsloaderHasCS", f"MintsloaderPs/{sha(two)}", f"MintsloaderCS/{sha(code)}") in links(got.edges)
    decoded = codec.strict_base64(cert)
    assert ("MintsloaderX509Cert", sha(decoded)) in keys(got.vertices)
    assert [r["stage"] for r in got.errors.where("path = 'bad'").collect()] == ["xor"]


def test_archive_chain(spark):
    leaf = archives.build_zip({"classes.dex": DEX})
    inner = archives.build_zip({"leaf.apk": leaf, "lib/x86/l.so": ELF})
    outer = archives.build_zip({"inner.apk": inner, "lib/mips/skipped.so": ELF, "lib/arm64-v8a/no.so": b"text", "bad.dex": b"zzzzzzz1"}, encrypted_flag=True)
    got = families.coper(files(spark, {"o": outer, "cut": outer[:100], "e": ELF, "d": DEX}))
    seen = keys(got.vertices)
    assert {("CoperAPK", sha(x)) for x in (outer, inner, leaf, outer[:100])} | {("CoperELF", sha(ELF)), ("CoperDEX", sha(DEX))} <= seen
    assert ("CoperDEX", sha(b"zzzzzzz1")) not in seen
    have = links(got.edges)
    apk = lambda x: f"CoperAPK/{sha(x)}"
    assert {("CoperHasInnerAPK", apk(outer), apk(inner)), ("CoperHasInnerAPK", apk(outer), apk(leaf)), ("CoperHasInnerAPK", apk(inner), apk(leaf))} <= have
    assert {("CoperHasAPK", "Coper/Coper", apk(x)) for x in (outer, inner, leaf, outer[:100])} <= have
    assert ("CoperHasDEX", apk(leaf), f"CoperDEX/{sha(DEX)}") in have
    cut = got.vertices.where(f"_key = '{sha(outer[:100])}'").first()
    assert cut["attrs"]["is_cut"] == "true"
    ref = families.coper(files(spark, {"o": outer}), mode="ref")
    assert ("CoperDEX", sha(b"zzzzzzz1")) in keys(ref.vertices)


def test_program_chain_and_store(spark, tmp_path):
    artifacts = spark.createDataFrame([(sha(b"MZ inert"), bytearray(b"script"))], "parent_sha256 string, content binary")
    samples = files(spark, {"p": b"MZ inert", "q": b"MZ lonely", "j": b"var x;", "s": b"abc"})
    store = GraphStore(spark, f"file://{tmp_path}/g")
    for _ in range(2):
        got = families.focused("dark-watchmen", samples, store, artifacts=artifacts)
    assert ("DarkWatchmenPE", sha(b"MZ lonely")) not in keys(got.vertices)
    assert ("DarkWatchmenHasJS", f"DarkWatchmenPE/{sha(b'MZ inert')}", f"DarkWatchmenJS/{sha(b'script')}") in links(store.edges)
    assert {(r["path"], r["stage"]) for r in got.errors.collect()} == {("q", "pe"), ("s", "classify")}
    assert store.vertices.count() == len(keys(store.vertices)) == 5 + 3
    with pytest.raises(ValueError):
        families.focused("unknown", samples)


def test_archives_nest_without_limit(spark):
    content, shas = archives.build_zip({"classes.dex": DEX}), []
    for _ in range(14):
        shas.append(sha(content))
        content = archives.build_zip({"next.apk": content})
    got = families.coper(files(spark, {"deep": content}))
    assert {k for c, k in keys(got.vertices) if c == "CoperAPK"} == {*shas, sha(content)}
    have = links(got.edges)
    assert ("CoperHasInnerAPK", f"CoperAPK/{sha(content)}", f"CoperAPK/{shas[0]}") in have
    assert sum(c == "CoperHasInnerAPK" for c, _, _ in have) == 15 * 14 // 2


def test_contents_of_nested_archives_stay_in_their_task(spark, monkeypatch):
    inner = archives.build_zip({"classes.dex": DEX})
    contents = {"a": archives.build_zip({"x.apk": inner, "y.apk": inner, "bad.apk": b"PKbroken"}), "b": inner, "c": archives.build_zip({"z.apk": inner})}
    written = []
    monkeypatch.setattr(families, "spool", lambda df, name, spool=families.spool: written.append(df) or spool(df, name))
    got = families.coper(files(spark, {**contents, "again": contents["a"]}))
    assert keys(got.vertices) >= {("CoperAPK", sha(c)) for c in [*contents.values(), b"PKbroken"]} | {("CoperDEX", sha(DEX))}
    assert got.errors.count() == 0 and got.vertices.groupBy("collection", "_key").count().where("count > 1").count() == 0
    assert not any(kind == "binary" for f in written for _, kind in f.dtypes)


def test_members_too_large_are_errors(spark, monkeypatch):
    monkeypatch.setattr(archives, "MOST_MEMBER", 100)
    with pytest.raises(archives.ZipError):
        archives.read_member(archives.build_zip({"a.dex": b"x" * 101}), "a.dex")


def test_directory_entries():
    plain, streamed = (archives.build_zip({"a": b"one" * 9, "ü": b""}, streamed=s) for s in (False, True))
    assert [(e.name, e.size, e.descriptor) for e in archives.entries(plain)] == [("a", 27, None), ("ü", 0, None)]
    found = archives.entries(streamed)
    assert [(e.name, e.size) for e in found] == [("a", 27), ("ü", 0)] and all(e.descriptor == (e.crc, e.packed, e.size) for e in found)
    unsigned = streamed.replace(b"PK\x07\x08", b"", 1)
    assert archives.read_member(streamed, "a") == b"one" * 9
    with pytest.raises(archives.ZipError):
        archives.entries(unsigned)
    with pytest.raises(archives.ZipError):
        archives.entries(b"none")


def test_listed_files_keep_a_row_each(spark, tmp_path):
    from loam.sources.files import read_listed

    (tmp_path / "fam").mkdir()
    (tmp_path / "fam" / "a").write_bytes(b"one")
    rows = [(str(tmp_path / "fam" / "a"),), (f"file://{tmp_path}/fam/a",), (str(tmp_path / "fam"),), (str(tmp_path / "gone"),), (None,), ("no scheme://x",)]
    got = [(r["path"], r["content"], r["label"], r["error"] is not None) for r in read_listed(spark.createDataFrame(rows, "path string")).collect()]
    assert len(got) == 5 and sum(e for *_, e in got) == 3
    assert all(bytes(c) == b"one" and label == "fam" for _, c, label, e in got if not e)


def test_files_below_folders(spark, tmp_path):
    from loam.sources.files import read_files

    for name in ("a/1.txt", "a/2.bin", "b/1.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    got = read_files(spark, str(tmp_path), on_error="fail", names="*.txt")
    assert {(r["label"], bytes(r["content"])) for r in got.collect()} == {("a", b"a/1.txt"), ("b", b"b/1.txt")}


def test_empty_files_are_read(spark, tmp_path):
    from loam.sources.files import read_files

    for name in ("a/1.txt", "a/b/2.txt", "a/_no.txt", "a/.no.txt", "_no/1.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("")
    (tmp_path / "a" / "3.txt").write_text("x")
    for on_error in ("skip", "fail"):
        below = read_files(spark, str(tmp_path), on_error, "*.t[x]t")
        assert {(r["label"], bytes(r["content"])) for r in below.collect()} == {("a", b""), ("b", b""), ("a", b"x")} and below.count() == 3
        for paths in (str(tmp_path / "a"), [str(tmp_path / "a" / "1.txt"), f"file://{tmp_path}/a/3.t?t"]):
            assert sorted((r["label"], bytes(r["content"])) for r in read_files(spark, paths, on_error).collect()) == [("a", b""), ("a", b"x")]


def test_files_below_folders_are_not_listed_on_the_driver(spark, tmp_path):
    from loam.sources.files import read_files

    for k in range(50):
        (tmp_path / f"a{k % 3}").mkdir(exist_ok=True)
        (tmp_path / f"a{k % 3}" / f"{k} é%.txt").write_text(str(k))
    got = read_files(spark, [f"file://{tmp_path}/a0", f"{tmp_path}/a1", f"{tmp_path}/a2/"], "fail", "*.txt")
    assert not [p for p in got.inputFiles() if ".txt" in p]
    assert {(r["label"], r["path"].split("/")[-1], bytes(r["content"])) for r in got.collect()} == {(f"a{k % 3}", f"{k} é%.txt", str(k).encode()) for k in range(50)}


def test_a_further_family_plugs_in(spark, tmp_path, monkeypatch):
    from loam import schema

    monkeypatch.setattr(schema, "EDGE_DEFINITIONS", schema.EDGE_DEFINITIONS)
    monkeypatch.setattr(families, "FAMILIES", dict(families.FAMILIES))

    def plan(found):
        rows = found.selectExpr("'OwnFile' collection", "sha2(content, 256) _key", "cast(map() as map<string,string>) attrs")
        linked = families._edges(found.selectExpr("sha2(content, 256) sha"), "OwnHasFile", "Own", "Own", "OwnFile", "sha")
        return families._lineage([rows], [linked], [spark.createDataFrame([], "path string, stage string, message string")], "Own")

    families.register("own", plan, (("HasMalwareFamily", "FocusedCorpus", "Own"), ("OwnHasFile", "Own", "OwnFile")))
    store = GraphStore(spark, f"file://{tmp_path}/own")
    families.focused("own", files(spark, {"a": b"one"}), store)
    assert ("OwnFile", sha(b"one")) in keys(store.vertices) and ("OwnHasFile", "Own/Own", f"OwnFile/{sha(b'one')}") in links(store.edges)
    assert ("Own", "Own") in keys(store.vertices)


def test_flags_and_members():
    data = archives.build_zip({"a": b"one", "b": b"two"}, encrypted_flag=True, compress=False)
    clear = archives.clear_encryption_flags(data)
    assert archives.clear_encryption_flags(clear) == clear == archives.build_zip({"a": b"one", "b": b"two"}, compress=False)
    assert archives.read_member(data, "b") == b"two"
    assert archives.member_names(data[:30]) is None
    with pytest.raises(archives.ZipError):
        archives.clear_encryption_flags(b"no archive")


def test_ingest_and_general(spark, tmp_path):
    import random

    from loam.plans.general import general
    from loam.sources.files import files_by_label, read_files, validate_dir, validate_file
    from loam.streaming.ingest import ingest

    rng = random.Random(0)
    for family in ("f1", "f2"):
        (tmp_path / "in" / family).mkdir(parents=True)
        for k in range(3):
            body = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300))
            (tmp_path / "in" / family / f"{k}.txt").write_text(body)
    (tmp_path / "in" / "f2" / "tiny").write_text("x")
    read = read_files(spark, [f"{tmp_path}/in/f1", f"{tmp_path}/in/f2"])
    assert {(r["label"], len(r["files"])) for r in files_by_label(read).collect()} == {("f1", 3), ("f2", 4)}
    store = GraphStore(spark, f"file://{tmp_path}/general")
    sweep = general(read, str(tmp_path / "csv"), store, eps=range(90, 93), min_pts=range(2, 4))
    assert sweep.count() == 4 * 3 * 2 and store.edges.count() == 15 and store.vertices.count() == 7
    with pytest.raises(ValueError):
        general(read, on_error="fail")
    (tmp_path / "drop").mkdir()
    (tmp_path / "drop" / "a.bat").write_text("import pickle")
    focused = GraphStore(spark, f"file://{tmp_path}/focused")
    for _ in range(2):
        ingest(spark, f"{tmp_path}/drop", "carnavalheist", focused, f"{tmp_path}/checkpoint").awaitTermination()
    assert ("CarnavalheistPython", sha("import pickle")) in keys(focused.vertices)
    assert validate_file(f"{tmp_path}/drop/a.bat") and validate_dir(str(tmp_path))
    with pytest.raises(ValueError):
        validate_file(str(tmp_path))


def test_links_between_archives_are_closed_by_numbers(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(graph, "closure", lambda links, f=graph.closure: seen.append(dict(links.dtypes)) or f(links))
    pairs = [(sha(a), sha(b)) for a, b in ("ab", "bc", "ad", "cd", "ef")]
    closed = families._closed(spark.createDataFrame(pairs, "parent string, child string"))
    assert {tuple(r) for r in closed.collect()} == {(sha(a), sha(b)) for a, b in ("ab", "ac", "ad", "bc", "bd", "cd", "ef")} and closed.count() == 7
    assert seen == [{"parent": "bigint", "child": "bigint"}]
