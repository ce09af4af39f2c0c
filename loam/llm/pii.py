"""Personal data in text: patterns propose spans, checksums confirm them, context adjusts scores.

Base kinds (email, ip, card, phone) are fixed patterns with fixed tests and always
stay. Further kinds (iban, ssn) are proposed by pattern, confirmed by mod-97 or by
the rules for valid numbers, and kept if their score, which words nearby raise or
lower, reaches ``KEEP``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_rows, narrow_input

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

#: Score that a span of a further kind needs.
KEEP = 0.6
#: Characters on each side in which context words count.
NEAR = 48

# Each run of local-part characters is tried from its start only, which keeps long runs without "@" linear.
_LOCAL = "A-Za-z0-9._%+-"
_DOMAIN = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL_IN_RUN = re.compile(rf"(?<![{_LOCAL}])[{_LOCAL}]++{_DOMAIN}")
_EMAIL_HERE = re.compile(rf"[{_LOCAL}]++{_DOMAIN}")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Lengths of IBANs by country, from the public registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_REST = {n: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in sorted(set(IBAN_LENGTHS.values()))}
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")

_ANY_DIGIT = re.compile(r"[0-9]")
_WORDS = re.compile(r"[a-z]+")
_FOR = {
    "email": {"mail", "email", "contact", "write", "address", "reach"},
    "ip": {"ip", "host", "address", "server", "login", "client", "from"},
    "card": {"card", "credit", "visa", "mastercard", "amex", "payment", "debit", "cvv"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "cell", "contact"},
    "iban": {"iban", "bank", "account", "transfer", "bic", "swift", "konto"},
    "ssn": {"ssn", "social", "security", "taxpayer", "insurance"},
}
_AGAINST = {"example", "sample", "test", "dummy", "version", "isbn", "order", "part", "serial", "model"}
_START = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.5}

SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The ISO 7064 check of an IBAN without blanks."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * 10 + ord(c) - 48 if c <= "9" else rest * 100 + ord(c) - 55) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern: a run's start, or the place where the last match ended within a run."""
    if "@" not in text:
        return
    at = 0
    while (m := at and _EMAIL_HERE.match(text, at) or _EMAIL_IN_RUN.search(text, at)) is not None:
        yield m.span()
        at = m.end()


def _part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    for a, b in _emails(text):
        yield "email", a, b
    if not _ANY_DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(map(_part_fits, m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        # A country's IBANs have one length, so a word behind it is no part of it.
        n = IBAN_LENGTHS.get(m[0][:2])
        rest = n and _IBAN_REST[n].match(text, m.end())
        if rest and mod97((m[0] + rest[0]).replace(" ", "")):
            yield "iban", m.start(), rest.end()
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield "ssn", *m.span()


def _score(kind: str, start: int, end: int, text: str) -> float:
    near = {*_WORDS.findall(text[max(0, start - NEAR) : start].lower()), *_WORDS.findall(text[end : end + NEAR].lower())}
    return min(1.0, max(0.0, _START[kind] + 0.2 * bool(near & _FOR[kind]) - 0.3 * bool(near & _AGAINST)))


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text by kind as in ``KINDS``, then start; offsets are code points, ends exclusive."""
    found = [Span(kind, a, b, _score(kind, a, b, text)) for kind, a, b in _proposals(text or "")]
    return [s for s in found if s.kind in BASE_KINDS or s.score >= KEEP]


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first stays."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def _detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    for batch in batches:
        spans = [[s._asdict() for s in find_spans(t.as_py())] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)`` for every row: all spans with their scores.

    A null text counts as empty and has no spans; a null id stays null; repeated rows
    each get their row; other columns are ignored; an empty table gives no rows.
    """
    return narrow_input(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        _detected, f"doc_id long, spans {SPANS}"
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts, a digest of the base spans, a list of all spans and one of their scores, per row of ``detect``."""
    as_text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of_kind = lambda *kinds: lambda s: s["kind"].isin(*kinds)
    base = F.filter("spans", of_kind(*BASE_KINDS))
    scores = F.transform("spans", lambda s: F.format_number(s["score"], 2))
    return found.select(
        "doc_id",
        *(F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.transform(base, as_text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", as_text), ",").alias("spans"),
        F.array_join(scores, ",").alias("scores"),
    )


def _masked(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if (t := x.as_py()) is None else mask(t, find_spans(t)) for x in batch.column(text_at)]
        columns = batch.columns
        columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all spans masked in the text.

    Rows (repeated ones and those without an id too), columns and null texts stay; an
    empty table stays empty.
    """
    at = docs.columns.index(text_col)
    return map_rows(docs, lambda it: _masked(it, at))
