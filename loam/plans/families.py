"""Lineage of samples of known families: classify, unpack without executing, link by content.

Each family is a pure function of its files ``(path, content)``: it gives vertices, edges
and errors, the same on every run, for a set-based upsert. A stage that fails to unpack
keeps its vertex and root edge and adds an error row. Stages of one level are one
DataFrame; levels are joined by being computed from each other, never by a lookup.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam import schema
from loam.functions import codec, spans, text
from loam.operators import cluster, graph
from loam.sources.archives import nested_members
from loam.storage import spool

class Lineage(NamedTuple):
    vertices: DataFrame
    edges: DataFrame
    errors: DataFrame


def _sha(content: Column | str) -> Column:
    return F.sha2(content, 256)


def _vertices(stage: DataFrame, collection: str, sha: str = "sha", **attrs: Column) -> DataFrame:
    pairs = [x for name, value in attrs.items() for x in (F.lit(name), value.cast("string"))]
    empty = F.create_map().cast("map<string,string>")
    return stage.where(F.col(sha).isNotNull()).select(
        F.lit(collection).alias("collection"), F.col(sha).alias("_key"), (F.create_map(*pairs) if pairs else empty).alias("attrs")
    )


def _edges(stage: DataFrame, collection: str, source: str, source_key: str | Column, target: str, target_key: str) -> DataFrame:
    key = F.lit(source_key) if source_key == source else F.col(source_key) if isinstance(source_key, str) else source_key
    rows = stage.where(key.isNotNull() & F.col(target_key).isNotNull())
    return graph.edges(rows, collection, graph.vertex_id(F.lit(source), key), graph.vertex_id(F.lit(target), F.col(target_key)))


def _errors(stage: DataFrame, failed: Column, name: str, message: str) -> DataFrame:
    return stage.where(failed).select("path", F.lit(name).alias("stage"), F.lit(message).alias("message"))


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _lineage(vertices: list[DataFrame], edges: list[DataFrame], errors: list[DataFrame], family: str) -> Lineage:
    roots, links = graph.bootstrap(vertices[0].sparkSession, "FocusedCorpus", (family,))
    return Lineage(
        _distinct_vertices(_all([roots, *vertices])),
        _distinct_edges(_all([links, *edges])),
        _all(errors),
    )


def _distinct_edges(rows: DataFrame) -> DataFrame:
    """One row for each edge; its key, which its ends make, isn't shuffled."""
    ends = rows.select("collection", "_from", "_to").distinct()
    return ends.select("collection", graph.edge_key("_from", "_to").alias("_key"), "_from", "_to", F.lit(None).cast("long").alias("ssdeep_distance"))


def _distinct_vertices(rows: DataFrame) -> DataFrame:
    """One row for each vertex; of differing attributes the least stays (maps have no order, so their text is compared)."""
    as_text = F.to_json("attrs")
    best = F.min_by("attrs", as_text).alias("attrs")
    return rows.groupBy("collection", "_key").agg(best)


def _with_text(files: DataFrame) -> DataFrame:
    return files.select("path", F.col("content").cast("binary").alias("content")).withColumns({"text": codec.text_of_udf()("content"), "sha": _sha("content")})


def carnavalheist(files: DataFrame) -> Lineage:
    """Batch, then PowerShell, then Python; Python files that are given stand alone."""
    first = spool(_with_text(files).drop("content").withColumn("kind", text.classify_batch_family(F.col("text"))), "batch")
    batches = first.where("kind like 'Batch%'").select(
        "path", "sha", "kind",
        F.when(F.col("kind") == "BatchBase64", text.after_encoded_command(F.col("text")))
        .otherwise(F.encode(spans.braced_command(F.col("text")), "utf-8")).alias("ps"),
        F.when(F.col("kind") == "BatchCommandConcat", "Concat").otherwise("Normal").alias("ps_type"),
    )
    # What is decoded is hashed where it is decoded: the branches below read digests.
    shells = batches.withColumns({"ps_text": codec.text_of_udf()("ps"), "ps_sha": _sha("ps")}).withColumn(
        "python", F.when(F.col("ps_type") == "Concat", text.concat_payload(F.col("ps_text"))).otherwise(text.quoted_payload(F.col("ps_text")))
    )
    shells = spool(shells.select("path", "sha", "kind", "ps_type", "ps_sha", _sha("python").alias("python_sha")), "shells")
    given = first.where("kind = 'Python'")
    return _lineage(
        [
            _vertices(shells, "CarnavalheistBatch", batch_type=F.when(F.col("kind") == "BatchBase64", "Base64").otherwise("Command")),
            _vertices(shells, "CarnavalheistPs", "ps_sha", ps_type=F.col("ps_type")),
            _vertices(shells, "CarnavalheistPython", "python_sha"), _vertices(given, "CarnavalheistPython"),
        ],
        [
            _edges(shells, "CarnavalheistHasBatch", "Carnavalheist", "Carnavalheist", "CarnavalheistBatch", "sha"),
            _edges(shells, "CarnavalheistHasPs", "CarnavalheistBatch", "sha", "CarnavalheistPs", "ps_sha"),
            _edges(shells, "CarnavalheistHasPython", "CarnavalheistPs", "ps_sha", "CarnavalheistPython", "python_sha"),
        ],
        [
            _errors(first, F.col("kind").isNull(), "classify", "the kind of the sample is unknown"),
            _errors(shells, F.col("ps_sha").isNull(), "batch", "no next stage in the batch stage"),
            _errors(shells, F.col("ps_sha").isNotNull() & F.col("python_sha").isNull(), "ps", "no next stage in the shell stage"),
        ],
        "Carnavalheist",
    )


def mintsloader(files: DataFrame) -> Lineage:
    """Scripts: an encrypted one unpacks to a further script; of array literals the two longest may be code or a certificate."""
    first = spool(_with_text(files).withColumn("kind", text.classify_script_family(F.col("text"))), "scripts")
    scripts = first.where("kind in ('XorBase64', 'DgaIex', 'StartProcess', 'TwoLiner')")
    unpacked = scripts.where("kind = 'XorBase64'").select(
        "path", "sha", codec.unxor_gunzip_udf()(text.xor_key(F.col("text")), text.xor_blob(F.col("text"))).alias("inner")
    )
    unpacked = spool(unpacked, "unpacked").withColumn("inner_kind", text.classify_unpacked(F.col("inner"))).withColumn(
        "inner_sha", F.when(F.col("inner_kind").isNotNull(), _sha(F.encode("inner", "utf-8")))
    )
    # An encrypted script that doesn't unpack isn't looked through any further.
    broken = unpacked.where("inner is null").select("path", "sha")
    holders = scripts.where("kind in ('XorBase64', 'TwoLiner')").join(broken.select("path"), "path", "left_anti")
    strings = holders.select("path", "sha", F.posexplode(F.slice(codec.decoded_literals_udf()("text"), 1, 2)).alias("place", "value"))
    strings = spool(strings, "strings").withColumns(
        {
            "cert": F.when(F.startswith("value", F.lit(text.X509_START)), text.strict_base64(F.col("value"))),
            "code": F.when(~F.startswith("value", F.lit(text.X509_START)) & F.startswith("value", F.lit(text.CS_START)), F.encode("value", "utf-8")),
        }
    ).withColumns({"cert_sha": _sha("cert"), "code_sha": _sha("code")})
    given = first.where("kind in ('CS', 'X509')").withColumns(
        {
            "code_sha": F.when(F.col("kind") == "CS", F.col("sha")),
            "cert": F.when(F.col("kind") == "X509", text.strict_base64(codec.text_of_udf()("content"))),
        }
    ).withColumn("cert_sha", _sha("cert"))
    return _lineage(
        [
            _vertices(scripts, "MintsloaderPs", kind=F.col("kind")), _vertices(unpacked, "MintsloaderPs", "inner_sha", kind=F.col("inner_kind")),
            _vertices(strings, "MintsloaderCS", "code_sha"), _vertices(strings, "MintsloaderX509Cert", "cert_sha"),
            _vertices(given, "MintsloaderCS", "code_sha"), _vertices(given, "MintsloaderX509Cert", "cert_sha"),
        ],
        [
            _edges(scripts, "MintsloaderHasPs", "Mintsloader", "Mintsloader", "MintsloaderPs", "sha"),
            _edges(unpacked, "MintsloaderHasPs", "MintsloaderPs", "sha", "MintsloaderPs", "inner_sha"),
            _edges(strings, "MintsloaderHasCS", "MintsloaderPs", "sha", "MintsloaderCS", "code_sha"),
            _edges(strings, "MintsloaderHasX509Cert", "MintsloaderPs", "sha", "MintsloaderX509Cert", "cert_sha"),
        ],
        [
            _errors(first, F.col("kind").isNull(), "classify", "the kind of the sample is unknown"),
            _errors(unpacked, F.col("inner").isNull(), "xor", "the next stage can't be unpacked"),
            _errors(strings, F.startswith("value", F.lit(text.X509_START)) & F.col("cert").isNull(), "x509", "the certificate is not canonical base64"),
            _errors(given, (F.col("kind") == "X509") & F.col("cert").isNull(), "x509", "the certificate is not canonical base64"),
        ],
        "Mintsloader",
    )


def dark_watchmen(files: DataFrame, artifacts: DataFrame) -> Lineage:
    """Programs and the scripts they drop. Nothing is executed: ``artifacts(parent_sha256, content)`` were collected before.

    A program without its script is an error and gives no vertex.
    """
    first = spool(
        files.select("path", F.col("content").cast("binary").alias("content")).select(
            "path", _sha("content").alias("sha"), text.classify_program_family(F.col("content")).alias("kind")
        ),
        "programs",
    )
    dropped = artifacts.select(F.col("parent_sha256").alias("sha"), _sha(F.col("content").cast("binary")).alias("js_sha"))
    programs = first.where("kind = 'PE'").join(dropped, "sha", "left")
    whole = programs.where("js_sha is not null")
    return _lineage(
        [_vertices(whole, "DarkWatchmenPE"), _vertices(whole, "DarkWatchmenJS", "js_sha"), _vertices(first.where("kind = 'JS'"), "DarkWatchmenJS")],
        [
            _edges(whole, "DarkWatchmenHasPE", "DarkWatchmen", "DarkWatchmen", "DarkWatchmenPE", "sha"),
            _edges(whole, "DarkWatchmenHasJS", "DarkWatchmenPE", "sha", "DarkWatchmenJS", "js_sha"),
        ],
        [
            _errors(first, F.col("kind").isNull(), "classify", "the kind of the sample is unknown"),
            _errors(programs, F.col("js_sha").isNull(), "pe", "no artifact was collected"),
        ],
        "DarkWatchmen",
    )


def _closed(links: DataFrame) -> DataFrame:
    """``(ancestor, descendant)`` of the closure of links between digests, by numbers: a digest has the length of eight of them."""
    digests = links.select(F.explode(F.array("parent", "child")).alias("digest")).distinct()
    numbers = spool(cluster.numbered(digests, "digest"), "numbers")
    named = lambda end: numbers.select(F.col("digest").alias(end), F.col("number").alias(f"{end}_number"))
    numbered = links.join(named("parent"), "parent").join(named("child"), "child").select(F.col("parent_number").alias("parent"), F.col("child_number").alias("child"))
    closed = graph.closure(numbered).select(F.col("ancestor").alias("ancestor_number"), F.col("descendant").alias("descendant_number"))
    return closed.join(named("ancestor"), "ancestor_number").join(named("descendant"), "descendant_number").select("ancestor", "descendant")


def coper(files: DataFrame, mode: str = "std") -> Lineage:
    """Archives with native libraries, bytecode and further archives, however deep.

    An archive is opened with all that are in it, and what these hold is hashed there.
    ``mode='ref'`` also takes bytecode members that lack the magic but have a non-zero eighth byte.
    """
    given = files.select("path", F.col("content").cast("binary").alias("content")).withColumns(
        {"sha": _sha("content"), "kind": text.classify_archive_family(F.col("content")), "architecture": text.elf_architecture(F.col("content"))}
    )
    first = spool(given.drop("content"), "archives")
    found = nested_members(given.where("kind = 'APK'").select(F.col("sha").alias("id"), "content"))
    head, kind, architecture = F.col("head"), text.member_kind(F.col("member")), text.architecture_from_path(F.col("member"))
    dex = text.is_dex(head)
    if mode == "ref":
        dex = dex | (text.byte_at(head, 7) != 0)
    fits = (
        F.when(kind == "APK", F.startswith(head, F.unhex(F.lit("504B"))))
        .when(kind == "ELF", text.is_elf(head) & architecture.isNotNull())
        .when(kind == "DEX", F.coalesce(dex, F.lit(False)))
    )
    rows = spool(found.select("id", "member", "is_cut", "error", "sha", kind.alias("kind"), F.coalesce(fits, F.lit(False)).alias("fits"), architecture.alias("architecture")), "members")
    archives, inside = rows.where("member is null"), rows.where("fits").select("id", "kind", "sha", "architecture")
    inner = inside.where("kind = 'APK'").select(F.col("id").alias("parent"), F.col("sha").alias("child"))
    closed = _closed(inner).select(F.col("ancestor").alias("id"), F.col("descendant").alias("sha"))
    given = first.where("kind in ('ELF', 'DEX')")
    elfs = _vertices(inside.where("kind = 'ELF'"), "CoperELF", architecture=F.col("architecture")).unionByName(
        _vertices(given.where("kind = 'ELF'"), "CoperELF", architecture=F.col("architecture"))
    )
    failed = rows.where("error is not null").select(F.col("id").alias("path"), F.lit("member").alias("stage"), F.concat_ws(": ", "member", "error").alias("message"))
    return _lineage(
        [
            _vertices(archives, "CoperAPK", "id", is_cut=F.col("is_cut")), elfs,
            _vertices(inside.where("kind = 'DEX'"), "CoperDEX"), _vertices(given.where("kind = 'DEX'"), "CoperDEX"),
        ],
        [
            _edges(archives, "CoperHasAPK", "Coper", "Coper", "CoperAPK", "id"),
            _edges(closed, "CoperHasInnerAPK", "CoperAPK", "id", "CoperAPK", "sha"),
            _edges(inside.where("kind = 'ELF'"), "CoperHasELF", "CoperAPK", "id", "CoperELF", "sha"),
            _edges(inside.where("kind = 'DEX'"), "CoperHasDEX", "CoperAPK", "id", "CoperDEX", "sha"),
        ],
        [_errors(first, F.col("kind").isNull(), "classify", "the kind of the sample is unknown"), failed],
        "Coper",
    )


FAMILIES: dict[str, Callable[..., Lineage]] = {
    "carnavalheist": carnavalheist, "coper": coper, "dark-watchmen": dark_watchmen, "mintsloader": mintsloader,
}


def register(name: str, plan: Callable[..., Lineage], definitions: tuple[tuple[str, str, str], ...]) -> None:
    """Make a further family known: its plan, and the edges ``(collection, from, to)`` that it may give, its root's among them."""
    FAMILIES[name] = plan
    schema.EDGE_DEFINITIONS = tuple(dict.fromkeys((*schema.EDGE_DEFINITIONS, *definitions)))


def roots() -> tuple[str, ...]:
    """The collections of the families' roots, as the edge definitions have them."""
    return tuple(sorted({to for collection, _, to in schema.EDGE_DEFINITIONS if collection == "HasMalwareFamily"}))


def focused(family: str, files: DataFrame, store: graph.GraphStore | None = None, **options) -> Lineage:
    """The lineage of ``files``; with a store, also upserted there."""
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}; known: {', '.join(FAMILIES)}")
    found = FAMILIES[family](files, **options)
    if store is not None:
        store.init("FocusedCorpus", roots())
        store.upsert(found.vertices, found.edges)
    return found
