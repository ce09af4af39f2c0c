"""Decoders that no built-in expresses, as plain functions and Arrow UDFs over them."""

from __future__ import annotations

import base64
import binascii
import gzip
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.functions import arrow_udf, pandas_udf

#: Bytes that one stage may unpack to: what a cell of a table can hold, with room to spare.
MOST_UNPACKED = 1 << 30
# Fixed value: the share of zero bytes at odd offsets beyond which content is UTF-16.
UTF16_SHARE = 0.98


def text_of(content: bytes | None) -> str | None:
    """UTF-16LE if over 98 % of the odd bytes are zero, else UTF-8; malformed parts become U+FFFD."""
    if content is None:
        return None
    zeros = content[1::2].count(0)
    # Compared in single precision, strictly.
    if content and _single(2 * zeros / len(content)) > _single(UTF16_SHARE):
        return content[: len(content) // 2 * 2].decode("utf-16-le", "replace")
    return content.decode("utf-8", "replace")


_PAREN_OR_FOREIGN = re.compile(r"[()]|[^\x00-\x7f]")


def _single(x: float) -> float:
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def _closing(text: str, start: int, opening: str, closing: str) -> int | None:
    """The end (past the closing mark) of a span that begins at depth 1; the text's end if unclosed; None at a non-ASCII character."""
    depth, i = 1, start
    while depth and i < len(text):
        c = text[i]
        if c > "\x7f":
            return None
        depth += (c == opening) - (c == closing)
        i += 1
    return i


# Fixed value: what a command block follows.
COMMAND_MARK = 'powershell -WindowStyle Hidden -Command "& {'


def braced_command(text: str | None) -> str | None:
    """What the command block after the marker and one more character holds; None if there is none."""
    at = (text or "").find(COMMAND_MARK)
    if at < 0:
        return None
    start = at + len(COMMAND_MARK) + 1
    end = _closing(text, start, "{", "}")
    return None if end is None or end <= start else text[start : end - 1]


def array_literals(text: str | None) -> list[str] | None:
    """The contents of all ``@( )``, inner ones too, trimmed; empty ones and those with non-ASCII characters are left out.

    An unclosed one runs to the text's end less one character. One pass, with a stack of open parentheses.
    """
    if text is None:
        return None
    pending: list[tuple[int, int] | None] = []
    closed: list[tuple[int, int]] = []
    foreign = 0
    for m in _PAREN_OR_FOREIGN.finditer(text):
        c, at = m[0], m.start()
        if c == "(":
            pending.append((at + 1, foreign) if at and text[at - 1] == "@" else None)
        elif c != ")":
            foreign += 1
        elif pending and (opened := pending.pop()) is not None and opened[1] == foreign:
            closed.append((opened[0], at))
    closed += [(start, max(start, len(text) - 1)) for start, before in filter(None, pending) if before == foreign]
    return [inner for a, b in sorted(closed) if (inner := text[a:b].strip())]


_RANK = {"+": 1, "-": 1, "*": 2, "/": 2, "%": 2, "~": 3, "^": 4}


def evaluate(expression: str) -> float:
    """The value of an arithmetic expression of numbers, ``+ - * / % ^``, unary minus and parentheses.

    Raises ``ValueError`` if it is malformed. Two stacks, no recursion.
    """
    values: list[float] = []
    pending: list[str] = []

    def reduce() -> None:
        op = pending.pop()
        if op == "~":
            if not values:
                raise ValueError(expression)
            values.append(-values.pop())
            return
        if len(values) < 2:
            raise ValueError(expression)
        b, a = values.pop(), values.pop()
        try:
            values.append({"+": a + b, "-": a - b, "*": a * b}[op] if op in "+-*" else a / b if op == "/" else a % b if op == "%" else float(a**b))
        except (ZeroDivisionError, OverflowError, TypeError) as e:
            raise ValueError(expression) from e

    operand, i, n = True, 0, len(expression)
    while i < n:
        c = expression[i]
        if c.isspace():
            i += 1
        elif c.isdigit() or c == ".":
            j = i
            while j < n and (expression[j].isdigit() or expression[j] == "."):
                j += 1
            if not operand:
                raise ValueError(expression)
            values.append(float(expression[i:j]))
            operand, i = False, j
        elif c == "(" and operand:
            pending.append(c)
            i += 1
        elif c == ")" and not operand:
            while pending and pending[-1] != "(":
                reduce()
            if not pending:
                raise ValueError(expression)
            pending.pop()
            i += 1
        elif operand and c in "+-":
            if c == "-":
                pending.append("~")
            i += 1
        elif not operand and c in "+-*/%^":
            while pending and pending[-1] != "(" and (_RANK[pending[-1]] > _RANK[c] or _RANK[pending[-1]] == _RANK[c] and c != "^"):
                reduce()
            pending.append(c)
            operand = True
            i += 1
        else:
            raise ValueError(expression)
    if operand:
        raise ValueError(expression)
    while pending:
        if pending[-1] == "(":
            raise ValueError(expression)
        reduce()
    return values[0]


#: Codes come from a small alphabet, so most expressions of a script are known already.
_KNOWN = 65_536


@lru_cache(_KNOWN)
def _character(expression: str) -> str | None:
    try:
        value = evaluate(expression)
    except ValueError:
        return None
    return chr(0 if value != value else int(min(max(value, 0.0), 255.0)))


def characters_of(codes: str) -> str | None:
    """Comma-separated expressions as characters by code; values saturate at 0 and 255, NaN is 0; None if one fails."""
    out = []
    for expression in codes.split(","):
        # Long ones aren't kept.
        if (character := (_character if len(expression) <= 64 else _character.__wrapped__)(expression)) is None:
            return None
        out.append(character)
    return "".join(out)


def decoded_literals(text: str | None) -> list[str] | None:
    """All array literals as characters, longest (in UTF-8) first; ties keep their order."""
    found = array_literals(text)
    if found is None:
        return None
    decoded = [s for s in map(characters_of, found) if s is not None]
    return sorted(decoded, key=lambda s: -len(s.encode()))


def strict_base64(text: str) -> bytes | None:
    try:
        out = base64.b64decode(text, validate=True)
    except (binascii.Error, ValueError):
        return None
    return out if base64.b64encode(out).decode() == text else None


def _xored(data: bytes, pad: bytes) -> bytes:
    return (np.frombuffer(data, np.uint8) ^ np.resize(np.frombuffer(pad, np.uint8), len(data))).tobytes()


def unxor_gunzip(key: str | None, blob: str | None) -> str | None:
    """base64, XOR with the repeated key, gunzip, strict UTF-8; None if a step fails or the result is too large."""
    if not key or blob is None or (data := strict_base64(blob)) is None:
        return None
    mixed = _xored(data, key.encode())
    try:
        unpack = zlib.decompressobj(31)
        out = unpack.decompress(mixed, MOST_UNPACKED)
        return out.decode() if unpack.eof else None
    except (zlib.error, UnicodeDecodeError):
        return None


def xor_gzip(key: str, text: str) -> str:
    """The inverse of ``unxor_gunzip``, for fixtures."""
    return base64.b64encode(_xored(gzip.compress(text.encode(), mtime=0), key.encode())).decode()


#: Values that a worker holds as Python objects at a time.
_HELD = 64
_SHAPES = {"string": pa.string(), "array<string>": pa.list_(pa.string())}


def _mapped(f: Callable, kind: str):
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = (batch.slice(at, _HELD).to_pylist() for at in range(0, len(batch), _HELD))
            yield pa.concat_arrays([pa.array([], _SHAPES[kind]), *(pa.array([None if x is None else f(x) for x in some], _SHAPES[kind]) for some in values)])

    apply.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(apply, kind)


def text_of_udf():
    return _mapped(text_of, "string")


def braced_command_udf():
    return _mapped(braced_command, "string")


def array_literals_udf():
    return _mapped(array_literals, "array<string>")


def characters_udf():
    return _mapped(characters_of, "string")


def decoded_literals_udf():
    return _mapped(decoded_literals, "array<string>")


def unxor_gunzip_udf():
    def apply(keys: pd.Series, blobs: pd.Series) -> pd.Series:
        return pd.Series([unxor_gunzip(k, b) for k, b in zip(keys, blobs, strict=True)], dtype=object)

    return pandas_udf(apply, "string")
