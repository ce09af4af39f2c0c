"""ZIP archives as rows: members of a binary column, and clearing of encryption flags."""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf

_END, _CENTRAL, _LOCAL, _DESCRIPTOR = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04", b"PK\x07\x08"
#: Bytes of a member that are read at most (what a cell of a table can hold, with room to spare); larger ones are an error.
MOST_MEMBER = 1 << 30

MEMBERS = "id string, member string, content binary, is_cut boolean, error string"


class ZipError(ValueError):
    pass


def _end_record(data: bytes) -> tuple[int, int]:
    """``(entries, directory offset)`` of the last end record whose comment fits the data."""
    at = data.rfind(_END)
    floor = max(0, len(data) - 65535 - 22)
    while at >= floor:
        if at + 22 <= len(data):
            entries, _, offset, comment = struct.unpack_from("<HIIH", data, at + 10)
            if at + 22 + comment <= len(data):
                return entries, offset
        at = data.rfind(_END, 0, at)
    raise ZipError("no end record")


class Entry(NamedTuple):
    name: str
    flags: int
    method: int
    crc: int
    packed: int
    size: int
    offset: int
    #: ``(crc, packed, size)`` behind the data, where bit 3 of the local flags says that they are there.
    descriptor: tuple[int, int, int] | None


def entries(data: bytes) -> list[Entry]:
    """The central directory, each entry with the descriptor behind its data, if there is one.

    A local header whose sizes are left to a descriptor has zeros, so the data's end
    follows from the directory's sizes.
    """
    count, at = _end_record(data)
    found = []
    for _ in range(count):
        if data[at : at + 4] != _CENTRAL or at + 46 > len(data):
            raise ZipError("bad central header")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc, packed, size, name, extra, comment = struct.unpack_from("<IIIHHH", data, at + 16)
        local = struct.unpack_from("<I", data, at + 42)[0]
        if data[local : local + 4] != _LOCAL or local + 30 > len(data):
            raise ZipError("bad local header")
        local_flags = struct.unpack_from("<H", data, local + 6)[0]
        local_name, local_extra = struct.unpack_from("<HH", data, local + 26)
        end, descriptor = local + 30 + local_name + local_extra + packed, None
        if local_flags & 8:
            # The descriptor's signature may be left out.
            end += 4 * (data[end : end + 4] == _DESCRIPTOR)
            if end + 12 > len(data):
                raise ZipError("bad descriptor")
            descriptor = struct.unpack_from("<III", data, end)
        encoding = "utf-8" if flags & 0x800 else "cp437"
        found.append(Entry(data[at + 46 : at + 46 + name].decode(encoding), flags, method, crc, packed, size, local, descriptor))
        at += 46 + name + extra + comment
    return found


def entries_udf():
    @pandas_udf("array<struct<name:string,packed:long,size:long,descriptor_size:long>>")
    def listed(contents: pd.Series) -> pd.Series:
        def one(data):
            try:
                return None if data is None else [{"name": e.name, "packed": e.packed, "size": e.size, "descriptor_size": e.descriptor and e.descriptor[2]} for e in entries(bytes(data))]
            except (ZipError, struct.error, UnicodeDecodeError):
                return None

        return contents.map(one)

    return listed


def clear_encryption_flags(data: bytes) -> bytes:
    """The archive with flag bit 0 off in all local and central headers; nothing else changes."""
    entries, at = _end_record(data)
    out = bytearray(data)
    for _ in range(entries):
        if out[at : at + 4] != _CENTRAL or at + 46 > len(out):
            raise ZipError("bad central header")
        name, extra, comment = struct.unpack_from("<HHH", out, at + 28)
        local = struct.unpack_from("<I", out, at + 42)[0]
        if out[local : local + 4] != _LOCAL or local + 30 > len(out):
            raise ZipError("bad local header")
        local_name, local_extra = struct.unpack_from("<HH", out, local + 26)
        if local_extra and out[local + 30 + local_name] == 1:
            raise ZipError("zip64")
        out[at + 8] &= 0xFE
        out[local + 6] &= 0xFE
        at += 46 + name + extra + comment
    return bytes(out)


def read_member(data: bytes, name: str, retry: bool = True) -> bytes:
    """A member's bytes; if it can't be opened, once more without encryption flags."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        try:
            member = archive.open(name)
        except (RuntimeError, NotImplementedError, zipfile.BadZipFile):
            if not retry:
                raise
            return read_member(clear_encryption_flags(data), name, retry=False)
        with member:
            out = member.read(MOST_MEMBER + 1)
    if len(out) > MOST_MEMBER:
        raise ZipError("the member is too large")
    return out


def member_names(data: bytes) -> list[str] | None:
    """Names in directory order; None if the archive can't be opened, for whatever reason."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            return archive.namelist()
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError, struct.error):
        return None


def _wanted(name: str) -> bool:
    return name.endswith(".apk") or name.startswith("lib/") or name.endswith(".dex")


#: Rows and bytes of members that a worker gathers before it passes them on.
_GATHERED = 256, 8 << 20


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """One row for each archive itself, then one for each wanted member."""
    for batch in batches:
        for i, data in zip(batch["id"], batch["content"], strict=True):
            data = b"" if data is None else bytes(data)
            names = member_names(data)
            yield i, None, None, names is None, None
            for name in filter(_wanted, names or []):
                try:
                    yield i, name, read_member(data, name), False, None
                except Exception as e:  # noqa: BLE001  a member may fail in any way; the others go on
                    yield i, name, None, False, f"{type(e).__name__}: {e}"


def _expanded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["id", "member", "content", "is_cut", "error"]
    held, size = [], 0
    for row in _rows(batches):
        held.append(row)
        size += len(row[2] or b"")
        if len(held) >= _GATHERED[0] or size >= _GATHERED[1]:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def members(archives: DataFrame) -> DataFrame:
    """Rows ``(id, content)`` as ``(id, member, content, is_cut, error)``: a row with null member for each archive, and its wanted members."""
    return archives.select("id", "content").mapInPandas(_expanded, MEMBERS)


NESTED = "id string, place int, member string, is_cut boolean, error string, sha string, head binary"
#: Bytes of a member that tell its kind.
_HEAD = 8


def _opened(digest: str, data: bytes) -> Iterator[tuple[tuple, bytes | None]]:
    """Rows of an archive, each with what its member holds if that may be an archive itself."""
    names = member_names(data)
    yield (digest, 0, None, names is None, None, None, None), None
    for place, name in enumerate(filter(_wanted, names or []), 1):
        try:
            content, error = read_member(data, name), None
        except Exception as e:  # noqa: BLE001  a member may fail in any way; the others go on
            content, error = None, f"{type(e).__name__}: {e}"
        if content is None:
            yield (digest, place, name, False, error, None, None), None
        else:
            inner = content if name.endswith(".apk") and content.startswith(b"PK") else None
            yield (digest, place, name, False, None, hashlib.sha256(content).hexdigest(), content[:_HEAD]), inner


def _nested_rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        for digest, data in zip(batch["id"], batch["content"], strict=True):
            # Depth first, so that the archives around the one that is open are held and no others; one may hold itself.
            seen, stack = {digest}, [_opened(digest, b"" if data is None else bytes(data))]
            while stack:
                row, inner = next(stack[-1], (None, None))
                if row is None:
                    stack.pop()
                    continue
                yield row
                if inner is not None and row[5] not in seen:
                    seen.add(row[5])
                    stack.append(_opened(row[5], inner))


def _nested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns, held = ["id", "place", "member", "is_cut", "error", "sha", "head"], []
    for row in _nested_rows(batches):
        held.append(row)
        if len(held) >= 16 * _GATHERED[0]:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def nested_members(archives: DataFrame) -> DataFrame:
    """``(id, place, member, is_cut, error, sha, head)`` of archives ``(id, content)`` and of all archives in them, however deep.

    ``id`` is an archive's SHA-256. Place 0, without a member, is the archive itself; wanted members count from 1, with
    their digest and first bytes. Contents stay in the task that opens them. An archive that is found in several has its rows once.
    """
    return archives.select("id", "content").mapInPandas(_nested, NESTED).dropDuplicates(["id", "place"])


def clear_flags_udf():
    @pandas_udf("binary")
    def clear(contents: pd.Series) -> pd.Series:
        def one(data):
            try:
                return None if data is None else clear_encryption_flags(bytes(data))
            except (ZipError, struct.error, IndexError):
                return None

        return contents.map(one)

    return clear


class _Stream(io.BytesIO):
    """A sink that can't go back, as a socket can't: sizes then go behind the data."""

    def seekable(self) -> bool:
        return False

    def seek(self, *_):
        raise io.UnsupportedOperation

    def tell(self):
        raise io.UnsupportedOperation


def build_zip(files: dict[str, bytes], encrypted_flag: bool = False, compress: bool = True, streamed: bool = False) -> bytes:
    """A small archive for fixtures."""
    out = _Stream() if streamed else io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if compress else zipfile.ZIP_STORED) as archive:
        for name, data in files.items():
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED if compress else zipfile.ZIP_STORED)
    data = bytearray(out.getvalue())
    if encrypted_flag:
        entries, at = _end_record(bytes(data))
        for _ in range(entries):
            name, extra, comment = struct.unpack_from("<HHH", data, at + 28)
            data[struct.unpack_from("<I", data, at + 42)[0] + 6] |= 1
            data[at + 8] |= 1
            at += 46 + name + extra + comment
    return bytes(data)
