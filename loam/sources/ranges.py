"""Members of large ZIP archives as a data source: several tasks read an archive, none reads it whole.

An archive's directory at its tail says where each member lies. The planner reads the
directories only and cuts them into ranges of successive members; a task reads its range's
part of the directory, and the bytes of its members. Archives are named by paths or
addresses that ``pyarrow.fs`` knows.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import pairwise
from typing import NamedTuple

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loam.sources.archives import MEMBERS, MOST_MEMBER, ZipError, _wanted

#: Packed bytes of the members that a task reads.
RANGE = 16 << 20

#: What a broken archive may raise when it is opened.
_BROKEN = (zipfile.BadZipFile, ValueError, OSError, NotImplementedError)


class Part(NamedTuple):
    """A part of an archive's directory: where it lies, and what the archive's own offsets are short of its places in the file."""

    at: int
    length: int
    shift: int


class _PartOfArchive:
    """A file as if its archive had the members of a part of the directory only: the file up to that part's end, and an end record."""

    def __init__(self, source, part: Part) -> None:
        self.source, self.end, self.place = source, part.at + part.length, 0
        offset = part.at - part.shift
        end = struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, min(part.length, 0xFFFFFFFF), min(offset, 0xFFFFFFFF), 0)
        if max(part.length, offset) >= 0xFFFFFFFF:
            wide = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 0xFFFF, 0xFFFF, part.length, offset)
            end = wide + struct.pack("<4sIQI", b"PK\x06\x07", 0, offset + part.length, 1) + end
        self.tail = end

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.place

    def seek(self, to: int, whence: int = io.SEEK_SET) -> int:
        place = to + {io.SEEK_SET: 0, io.SEEK_CUR: self.place, io.SEEK_END: self.end + len(self.tail)}[whence]
        if place < 0:
            raise OSError("before the start of the file")
        self.place = place
        return place

    def read(self, size: int = -1) -> bytes:
        most = self.end + len(self.tail) - self.place
        size = max(0, most if size is None or size < 0 else min(size, most))
        out = b""
        if size and self.place < self.end:
            self.source.seek(self.place)
            out = bytes(self.source.read(min(size, self.end - self.place)))
        at = self.place + len(out) - self.end
        if at >= 0:
            out += self.tail[at : at + size - len(out)]
        self.place += len(out)
        return out


@contextmanager
def _opened(path: str, part: Part | None = None) -> Iterator[zipfile.ZipFile]:
    store, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with store.open_input_file(name) as source, zipfile.ZipFile(source if part is None else _PartOfArchive(source, part)) as archive:
        yield archive


def _lengths(archive: zipfile.ZipFile) -> list[int] | None:
    """Bytes that each member takes in the directory; None where a member can't be told without the whole of it.

    That is where two members have one name, of which the last counts, or where members lie in
    another order than the directory's, as only all of them say whether one overlaps the next.
    """
    infos = archive.infolist()
    if len({i.filename for i in infos}) < len(infos) or any(a.header_offset >= b.header_offset for a, b in pairwise(infos)):
        return None
    archive.fp.seek(archive.start_dir)
    data, at, out = archive.fp.read(), 0, []
    for _ in infos:
        out.append(46 + sum(struct.unpack_from("<3H", data, at + 28)))
        at += out[-1]
    return out


def _shift(path: str, archive: zipfile.ZipFile, length: int) -> int:
    """What stands before an archive whose offsets don't count it."""
    with _opened(path, Part(archive.start_dir, length, 0)) as first:
        return archive.infolist()[0].header_offset - first.infolist()[0].header_offset


def _member(archive: zipfile.ZipFile, name: str) -> bytes:
    """A member's bytes; if it can't be opened, once more without its encryption flag."""
    info = archive.getinfo(name)
    try:
        member = archive.open(info)
    except (RuntimeError, NotImplementedError, zipfile.BadZipFile):
        info.flag_bits &= ~1
        member = archive.open(info)
    with member:
        out = member.read(MOST_MEMBER + 1)
    if len(out) > MOST_MEMBER:
        raise ZipError("the member is too large")
    return out


class Range(InputPartition):
    """Successive members of an archive; the first range of each also stands for the archive itself.

    ``members`` says which of the members in ``part`` of the directory these are; without ``part`` it is of the whole directory.
    """

    def __init__(self, path: str, members: tuple[int, int], part: Part | None, first: bool, is_cut: bool) -> None:
        self.path, self.members, self.part, self.first, self.is_cut = path, members, part, first, is_cut

    def wanted(self, archive: zipfile.ZipFile) -> list[str]:
        return [i.filename for i in archive.infolist()[slice(*self.members)] if _wanted(i.filename)]

    @property
    def names(self) -> list[str]:
        with _opened(self.path, self.part) as archive:
            return self.wanted(archive)


def _ranges(path: str, size: int) -> Iterator[Range]:
    with _opened(path) as archive:
        infos = archive.infolist()
        lengths = _lengths(archive) if infos else None
        shift = _shift(path, archive, lengths[0]) if lengths else 0
        bounds, held, there = [0], 0, False
        for k, info in enumerate(infos):
            if _wanted(info.filename):
                if there and held + info.compress_size > size:
                    bounds.append(k)
                    held, there = 0, False
                held, there = held + info.compress_size, True
        bounds.append(len(infos))
        at = archive.start_dir
        for start, end in pairwise(bounds):
            part, members = None, (start, end)
            if lengths is not None and end < len(infos):
                # One member more says where the last one has to end. The last range's has to where the directory begins, which the whole one says.
                own = sum(lengths[start:end])
                part, members = Part(at, own + lengths[end], shift), (0, end - start)
                at += own
            yield Range(path, members, part, not start, False)


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], size: int) -> None:
        self.paths, self.size = paths, size

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            try:
                out += list(_ranges(path, self.size))
            except _BROKEN:
                out.append(Range(path, (0, 0), None, True, True))
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.first:
            yield partition.path, None, None, partition.is_cut, None
        if partition.is_cut or partition.members[0] == partition.members[1]:
            return
        with _opened(partition.path, partition.part) as archive:
            for name in partition.wanted(archive):
                try:
                    content, error = _member(archive, name), None
                except Exception as e:  # noqa: BLE001  a member may fail in any way; the others go on
                    content, error = None, f"{type(e).__name__}: {e}"
                yield partition.path, name, content, False, error


class ZipMembers(DataSource):
    """``spark.read.format("zip_members").option("paths", <JSON list>).load()``; ``range`` bounds a task's packed bytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["paths"]), int(self.options.get("range", RANGE)))


def read_members(spark: SparkSession, paths: list[str], size: int = RANGE) -> DataFrame:
    """As ``archives.members`` of these files, with the path as ``id``: a row with null member for each archive, and its wanted members."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").option("paths", json.dumps(paths)).option("range", str(size)).load()
