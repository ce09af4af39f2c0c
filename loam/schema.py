"""The data model: vertex and edge collections of the two corpora, as explicit schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of collections, families, keys and enumerations.
ROOT_COLLECTIONS = ("FocusedCorpus", "GeneralCorpus", "Carnavalheist", "Coper", "DarkWatchmen", "Mintsloader")
SAMPLE_COLLECTIONS = {
    "CarnavalheistBatch": ("batch_type",),
    "CarnavalheistPs": ("ps_type",),
    "CarnavalheistPython": (),
    "CoperAPK": ("is_cut",),
    "CoperELF": ("architecture",),
    "CoperDEX": (),
    "DarkWatchmenPE": (),
    "DarkWatchmenJS": (),
    "MintsloaderPs": ("kind",),
    "MintsloaderCS": (),
    "MintsloaderX509Cert": (),
    "MalwareSample": ("ssdeep",),
}
ENUMS = {
    "batch_type": ("Base64", "Command"),
    "ps_type": ("Normal", "Concat"),
    "architecture": ("x86_64", "x86", "arm64-v8a", "armeabi-v7a"),
    "kind": ("XorBase64", "DgaIex", "StartProcess", "TwoLiner"),
}
EDGE_DEFINITIONS = (
    ("HasMalwareFamily", "FocusedCorpus", "Carnavalheist"),
    ("HasMalwareFamily", "FocusedCorpus", "Coper"),
    ("HasMalwareFamily", "FocusedCorpus", "DarkWatchmen"),
    ("HasMalwareFamily", "FocusedCorpus", "Mintsloader"),
    ("CarnavalheistHasBatch", "Carnavalheist", "CarnavalheistBatch"),
    ("CarnavalheistHasPs", "CarnavalheistBatch", "CarnavalheistPs"),
    ("CarnavalheistHasPython", "CarnavalheistPs", "CarnavalheistPython"),
    ("CoperHasAPK", "Coper", "CoperAPK"),
    ("CoperHasInnerAPK", "CoperAPK", "CoperAPK"),
    ("CoperHasELF", "CoperAPK", "CoperELF"),
    ("CoperHasDEX", "CoperAPK", "CoperDEX"),
    ("DarkWatchmenHasPE", "DarkWatchmen", "DarkWatchmenPE"),
    ("DarkWatchmenHasJS", "DarkWatchmenPE", "DarkWatchmenJS"),
    ("MintsloaderHasPs", "Mintsloader", "MintsloaderPs"),
    ("MintsloaderHasPs", "MintsloaderPs", "MintsloaderPs"),
    ("MintsloaderHasCS", "MintsloaderPs", "MintsloaderCS"),
    ("MintsloaderHasX509Cert", "MintsloaderPs", "MintsloaderX509Cert"),
    ("SampleDistance", "MalwareSample", "MalwareSample"),
    ("DummyEdge", "GeneralCorpus", "GeneralCorpus"),
)
DATABASES = {"focused": ("focused_corpus", "focused_corpus_graph"), "general": ("general_corpus", "general_corpus_graph")}

VERTICES = T.StructType(
    [
        T.StructField("collection", T.StringType(), False),
        T.StructField("_key", T.StringType(), False),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType()), True),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("collection", T.StringType(), False),
        T.StructField("_key", T.StringType(), False),
        T.StructField("_from", T.StringType(), False),
        T.StructField("_to", T.StringType(), False),
        T.StructField("ssdeep_distance", T.LongType(), True),
    ]
)


def unique_key(collection: str) -> str:
    """The field that identifies a vertex in its collection."""
    return "name" if collection in ROOT_COLLECTIONS else "sha256sum"


def index_name(collection: str, fields: list[str]) -> str:
    return f"{collection}--{'-'.join(fields)}"
