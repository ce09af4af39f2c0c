"""Files as rows, labels from folders, and the CSV sink of a sweep."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.text import parent_label
from loam.storage import spool


def validate_file(path: str) -> str:
    if not os.path.isfile(path):
        raise ValueError(f"not a regular file: {path}")
    return path


def validate_dir(path: str) -> str:
    if not os.path.isdir(path):
        raise ValueError(f"not a folder: {path}")
    return path


#: Bytes after which a batch of files is passed on, and those that a task reads, on average.
BATCH, SHARE = 1 << 20, 64 << 20


def read_files(spark: SparkSession, paths: str | list[str], on_error: str = "skip", names: str | None = None) -> DataFrame:
    """``(path, content, label)``, whole files, also those that hold nothing; the label is the folder's name.

    With ``names``, a pattern, paths are folders that ``pyarrow.fs`` reaches, and the files in and below them whose names
    match are read: tasks list the folders, and no list of files is on the driver, as it is of other paths.
    ``on_error='skip'`` leaves out files that can't be read, ``'fail'`` stops at the first.
    """
    paths = [paths] if isinstance(paths, str) else paths
    if names is not None:
        read = _read_listed(_dealt(_below(spark, paths, names)), on_error)
    else:
        reader = spark.read.format("binaryFile")
        if on_error == "skip":
            reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
        # Spark reads no rows from files without bytes.
        empty = spark.createDataFrame([(p, b"") for p in _empty(spark, paths)], "path string, content binary")
        read = reader.load(paths).select("path", "content").unionByName(empty)
    return read.select("path", "content", parent_label(F.col("path")).alias("label"))


def _hidden(name: str) -> bool:
    """Whether Spark's readers leave out a file or folder of this name."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _empty(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files without bytes that the paths, which may be patterns and folders, stand for."""
    found = []
    for path in (spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths):
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for given in store.globStatus(path) or ():
            inside = store.listStatusIterator(given.getPath()) if given.isDirectory() else None
            while given is not None:
                if given.isFile() and given.getLen() == 0 and not _hidden(given.getPath().getName()):
                    found.append(given.getPath().toString())
                given = inside.next() if inside is not None and inside.hasNext() else None
    return found


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """``(name, whether a folder, bytes)`` of what is in a folder; of a local one never all at once."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                if e.is_dir() or e.is_file():
                    yield e.name, e.is_dir(), e.stat().st_size
    else:
        for e in store.get_file_info(fs.FileSelector(folder)):
            if e.type in (fs.FileType.Directory, fs.FileType.File):
                yield e.base_name, e.type == fs.FileType.Directory, e.size or 0


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = ["root", "name", "folder", "size"]
    for batch in batches:
        for root, below in zip(*(batch.column(c).to_pylist() for c in ("root", "name")), strict=True):
            store, top = _store(root)
            found = ((root, f"{below}/{name}", is_folder, size) for name, is_folder, size in _entries(store, top + below) if not _hidden(name))
            while rows := list(islice(found, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], columns)


def _below(spark: SparkSession, folders: list[str], names: str) -> DataFrame:
    """``(root, name, size)`` of the files in and below ``folders`` that match, names from the folder on; a job for each level of folders."""
    matches = spark._jvm.org.apache.hadoop.fs.GlobPattern(names).compiled().pattern()
    shape = "root string, name string, folder boolean, size long"
    level, files = spark.createDataFrame([(f.rstrip("/"), "") for f in folders], "root string, name string"), []
    while not level.isEmpty():
        tasks = spark.sparkContext.defaultParallelism
        found = spool(level.repartition(tasks, "root", "name").mapInArrow(_list, shape), "listed")
        files.append(found.where(~F.col("folder") & F.element_at(F.split("name", "/"), -1).rlike(f"^(?:{matches})$")).drop("folder"))
        level = found.where("folder").select("root", "name")
    return reduce(DataFrame.unionByName, files)


def _dealt(listed: DataFrame) -> DataFrame:
    """Files dealt to tasks, by their bytes and number."""
    found = listed.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    tasks = max(4 * listed.sparkSession.sparkContext.defaultParallelism, (found["size"] or 0) // SHARE, found["n"] // 50_000)
    return listed.select("root", "name").repartition(tasks, "root", "name")


def _read(batches: Iterator[pa.RecordBatch], fail: bool = False) -> Iterator[pa.RecordBatch]:
    """Contents of ``(root, name)``, a file or a few small ones at a time: a batch of paths may stand for a lot of data."""
    stores, rows, size = {}, [], 0
    for batch in batches:
        for root, below in zip(*(batch.column(c).to_pylist() for c in ("root", "name")), strict=True):
            content, error = None, None
            try:
                # A path of its own isn't kept: there may be many.
                store, top = stores.get(root) or _store(root)
                if below:
                    stores[root] = store, top
                if store.get_file_info(top + below).type != fs.FileType.File:
                    raise FileNotFoundError("not a regular file")
                with store.open_input_stream(top + below, compression=None) as source:
                    content = source.read()
            except (OSError, ValueError, pa.ArrowInvalid) as e:
                if fail:
                    raise
                error = f"{type(e).__name__}: {e}"
            rows.append((root + below, content, error))
            size += len(content or b"")
            if size >= BATCH or len(rows) >= 1_000:
                yield _batch(rows)
                rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple[str, bytes | None, str | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.string()), strict=True)], ["path", "content", "error"])


def _read_listed(listed: DataFrame, on_error: str) -> DataFrame:
    read = listed.mapInArrow(lambda it: _read(it, on_error == "fail"), "path string, content binary, error string")
    return read.where("error is null") if on_error == "skip" else read


def read_listed(paths: DataFrame, path: str = "path") -> DataFrame:
    """``(path, content, label, error)`` for every path listed: files that can't be read keep their row, with the error.

    Null paths are left out. Paths are local ones or URIs that ``pyarrow.fs`` reaches.
    """
    listed = paths.select(F.col(path).cast("string").alias("root"), F.lit("").alias("name")).where("root is not null")
    return _read_listed(listed, "keep").select("path", "content", parent_label(F.col("path")).alias("label"), "error")


def files_by_label(rows: DataFrame, path: str = "path") -> DataFrame:
    """``(label, files)``: sorted paths per label; paths without a folder are left out."""
    labelled = rows.select(parent_label(F.col(path)).alias("label"), F.col(path).alias("path")).where("label is not null")
    return labelled.groupBy("label").agg(F.sort_array(F.collect_list("path")).alias("files"))


def write_sweep_csv(sweep: DataFrame, folder: str, mode: str = "ref") -> None:
    """A folder ``dbscan_{distance}.csv`` for each distance, rows by eps and min_pts. The third column's spelling is part of the format."""
    shaped = sweep.select(
        "distance", "eps", "min_pts", F.col("purity").alias("prurity"), "nmi", F.col(f"ri_{mode}").alias("ri"), F.col(f"f5_{mode}").alias("f5")
    )
    for (name,) in sweep.select("distance").distinct().orderBy("distance").collect():
        part = shaped.where(F.col("distance") == name).drop("distance")
        part.repartitionByRange("eps").sortWithinPartitions("eps", "min_pts").write.mode("overwrite").option("header", True).csv(f"{folder}/dbscan_{name}.csv")
