"""Classification, marker extraction and decoding as Column expressions (no Python workers)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers that tell the kinds of a stage apart, in order of precedence.
BATCH_BASE64 = "powershell -WindowStyle Hidden -e"
BATCH_COMMAND = "powershell -WindowStyle Hidden -Command"
CONCAT_MARK = 'set "base64='
PYTHON_MARKS = ("RANDOMIZADO", "import pickle", "import base64")
DGA_MARK = "$executioncontext;"
DGA_FETCH = ("$global:block=(curl", "iex(curl")
START_PROCESS = "start-process powershell"
CS_START = "using System"
X509_START = "MIIE"
FUNCTION_PATTERN = r"function\s+([A-z0-9]+)\s+\{param\([^\)]+\)"
KEY_PATTERN = r'\("([A-z0-9]{12})"\)'
BLOB_PATTERN = r'\s+"([A-z0-9+/=]+)"'
ARCHITECTURES = {0x03: "x86", 0x28: "armeabi-v7a", 0x3E: "x86_64", 0xB7: "arm64-v8a"}
LIB_FOLDERS = ("armeabi-v7a", "arm64-v8a", "x86_64", "x86")

# White space by Unicode's notion of it, as the inside of a Java character class.
_SPACE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _has(text: Column, *marks: str) -> Column:
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(text, F.lit(m))
    return found


def _extract(text: Column, pattern: Column, group: int) -> Column:
    """``regexp_extract`` with a pattern that depends on the row."""
    return F.call_function("regexp_extract", text, pattern, F.lit(group))


def trim(text: Column) -> Column:
    """Without white space at both ends, by Unicode's notion of it."""
    return F.regexp_replace(text, f"^[{_SPACE}]+|[{_SPACE}]+$", "")


def begins(text: Column, mark: str) -> Column:
    """Whether the text begins with ``mark`` after any white space, by Unicode's notion of it."""
    return text.rlike(rf"\A[{_SPACE}]*\Q{mark}\E")


def line_count(text: Column) -> Column:
    """Number of lines; a last line end begins no further line."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return ends + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)


def classify_batch_family(text: Column) -> Column:
    """BatchBase64, BatchCommandConcat, BatchCommandNormal, Python or null; the first that fits."""
    return (
        F.when(_has(text, BATCH_BASE64), "BatchBase64")
        .when(_has(text, BATCH_COMMAND), F.when(_has(text, CONCAT_MARK), "BatchCommandConcat").otherwise("BatchCommandNormal"))
        .when(_has(text, *PYTHON_MARKS), "Python")
    )


def xor_key(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, KEY_PATTERN, 1), F.lit(""))


def xor_function(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, FUNCTION_PATTERN, 1), F.lit(""))


def xor_blob(text: Column) -> Column:
    """The quoted base64 argument of the call of the function that the text itself defines."""
    name = F.regexp_replace(xor_function(text), r"([^A-Za-z0-9_])", r"\\$1")
    return F.nullif(_extract(text, F.concat(name, F.lit(BLOB_PATTERN)), 1), F.lit(""))


def classify_script_family(text: Column) -> Column:
    """XorBase64, DgaIex, StartProcess, CS, X509, TwoLiner or null; the first that fits."""
    return (
        F.when(F.when(xor_key(text).isNotNull(), xor_blob(text)).isNotNull(), "XorBase64")
        .when(_has(text, DGA_MARK) & _has(text, *DGA_FETCH), "DgaIex")
        .when(_has(text, START_PROCESS), "StartProcess")
        .when(begins(text, CS_START), "CS")
        .when(begins(text, X509_START), "X509")
        .when(line_count(text) < 5, "TwoLiner")
    )


def classify_unpacked(text: Column) -> Column:
    """The kind of a stage that an XorBase64 stage unpacks to; null if neither."""
    return F.when(_has(text, DGA_MARK), "DgaIex").when(_has(text, START_PROCESS), "StartProcess")


def byte_at(content: Column, offset: int) -> Column:
    """The byte at a 0-based offset as a number; null past the end."""
    return F.conv(F.nullif(F.hex(F.substring(content, offset + 1, 1)), F.lit("")), 16, 10).cast("int")


def _magic(content: Column, hexadecimal: str) -> Column:
    return F.startswith(content, F.unhex(F.lit(hexadecimal)))


def is_dex(content: Column) -> Column:
    return F.coalesce(_magic(content, "6465780A") & (byte_at(content, 7) == 0), F.lit(False))


def is_elf(content: Column) -> Column:
    return _magic(content, "7F454C46")


def classify_archive_family(content: Column) -> Column:
    """APK, DEX, ELF or null by magic bytes."""
    return F.when(_magic(content, "504B"), "APK").when(is_dex(content), "DEX").when(is_elf(content), "ELF")


def classify_program_family(content: Column) -> Column:
    """PE, else JS; null for fewer than four bytes."""
    return F.when(F.octet_length(content) >= 4, F.when(_magic(content, "4D5A") | _magic(content, "50450000"), "PE").otherwise("JS"))


def elf_architecture(content: Column) -> Column:
    machine = F.when(byte_at(content, 5) == 1, byte_at(content, 18)).when(byte_at(content, 5) == 2, byte_at(content, 19))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, name in ARCHITECTURES.items():
        out = out.when(machine == code, name)
    return out


def architecture_from_path(path: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in LIB_FOLDERS:
        out = out.when(F.startswith(path, F.lit(f"lib/{name}/")), name)
    return out


def member_kind(path: Column) -> Column:
    return F.when(F.endswith(path, F.lit(".apk")), "APK").when(F.startswith(path, F.lit("lib/")), "ELF").when(F.endswith(path, F.lit(".dex")), "DEX")


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once, however often it is named there: an expression that is named twice runs twice."""
    return F.element_at(F.transform(F.array(value), of), 1)


def plain_base64(content: Column) -> Column:
    """Base64 without the line ends that Spark may put into it."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def strict_base64(text: Column) -> Column:
    """Decoded bytes; null unless the text is canonical base64 of the standard alphabet."""
    canonical = lambda t: let(F.try_to_binary(t, F.lit("base64")), lambda d: F.when(plain_base64(d) == t, d))
    return let(text, canonical)


def repeated_base64(text: Column, times: Column) -> Column:
    """Decoded ``times`` times; null if any step fails. No times give the text's bytes."""
    steps = F.when(times > 0, F.sequence(F.lit(1), times.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.reduce(steps, text.cast("binary"), lambda acc, _: strict_base64(acc.cast("string")))


def after_encoded_command(text: Column) -> Column:
    """The base64 word after the marker and one more character; decoded. Needs white space after it."""
    def decoded(t: Column) -> Column:
        at = F.instr(t, BATCH_BASE64)
        # The word with the white space behind it, if there is one. Other characters aren't base64, and a class of few is matched much faster.
        word = F.regexp_extract(F.substr(t, at + len(BATCH_BASE64) + 1), f"^[A-Za-z0-9+/=]*+[{_SPACE}]", 0)
        return let(F.when(at > 0, word), lambda w: F.when(w != "", strict_base64(F.left(w, F.length(w) - 1))))

    return let(text, decoded)


DECODE_CALL = r"base64\.b64decode\("


def decode_calls(text: Column) -> Column:
    return F.regexp_count(text, F.lit(DECODE_CALL))


def _quoted(text: Column, opening: str) -> Column:
    """The first quoted literal after ``opening``, behind its last opening quote; an empty text without one."""
    # A literal ends with a quote, so what it holds is never given back. One that holds nothing is all quotes, before the bracket.
    nothing = rf"(?<=\({opening}(?:''|'{{6,7}}))(?=\))"
    return F.regexp_extract(text, rf"base64\.b64decode\({opening}'*('(?:{nothing}|[^']++(?=')))", 1)


def quoted_payload(text: Column) -> Column:
    """The quoted literal of the first plain, else of the first raw, decode call; decoded as often as calls occur."""
    def payload(t: Column) -> Column:
        literal = F.when(F.contains(t, F.lit("base64.b64decode('")), _quoted(t, "")).otherwise(_quoted(t, "r"))
        return let(literal, lambda q: F.when(q != "", repeated_base64(F.substr(q, F.lit(2)), decode_calls(t))))

    return let(text, payload)


def numbered_parts(text: Column) -> Column:
    """The values of ``base64_part0``, ``base64_part1``, ... up to the first gap, joined.

    Null if a part has no closing quote.
    """
    value = lambda i: _extract(text, F.concat(F.lit('set "base64_part'), i.cast("string"), F.lit('=([^"]*)"')), 1)
    there = lambda i: F.contains(text, F.concat(F.lit('set "base64_part'), i.cast("string"), F.lit("=")))
    most = F.regexp_count(text, F.lit('set "base64_part[0-9]+='))
    numbers = F.sequence(F.lit(0), most)
    gap = F.array_position(F.transform(numbers, there), False)
    taken = F.when(gap > 1, F.slice(numbers, F.lit(1), (gap - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    closed = lambda i: F.regexp_count(text, F.concat(F.lit('set "base64_part'), i.cast("string"), F.lit('=[^"]*"'))) > 0
    return F.when(F.forall(taken, closed), F.array_join(F.transform(taken, value), ""))


def concat_payload(text: Column) -> Column:
    return let(text, lambda t: repeated_base64(numbered_parts(t), decode_calls(t)))


# Fixed value: the base of the distance that a similarity maps to.
SIMILARITY_BASE = 1.0472


def similarity_to_distance(similarity: Column) -> Column:
    return F.pow(F.lit(SIMILARITY_BASE), F.lit(100) - similarity) - 1


def parent_label(path: Column) -> Column:
    """The name of the folder that a file is in; null without one."""
    return F.when(F.size(F.split(path, "/")) >= 2, F.nullif(F.element_at(F.split(path, "/"), -2), F.lit("")))
