import base64

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.functions import codec, spans, text

B64 = base64.b64encode(b"next stage").decode()


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("script", "kind"),
    [
        ("a powershell -WindowStyle Hidden -e x", "BatchBase64"),
        ("powershell -WindowStyle Hidden -Command y", "BatchCommandNormal"),
        ('set "base64=1" powershell -WindowStyle Hidden -Command y', "BatchCommandConcat"),
        ("import base64; powershell -WindowStyle Hidden -e x", "BatchBase64"),
        ("import base64", "Python"),
        ("", None),
    ],
)
def test_batch_family(spark, script, kind):
    assert one(spark, script, text.classify_batch_family) == kind


@pytest.mark.parametrize(
    ("script", "kind"),
    [
        ('function a]b {param($x)} $k=("abcdefghijkl"); a]b "QUJD"', "XorBase64"),
        ('function ab {param($x)} $k=("abcdefghijk"); ab "QUJD"\n\n\n\n\n', None),
        ("$executioncontext; iex(curl x)", "DgaIex"),
        ("$executioncontext;\n\n\n\n\n", None),
        ("start-process powershell", "StartProcess"),
        ("　using System;", "CS"),
        ("\n MIIEabc", "X509"),
        ("a\nb\nc\nd\n", "TwoLiner"),
        ("a\nb\nc\nd\ne", None),
        ("", "TwoLiner"),
    ],
)
def test_script_family(spark, script, kind):
    assert one(spark, script, text.classify_script_family) == kind


def test_magic(spark):
    def kinds(data):
        return spark.createDataFrame([(data,)], "x binary").select(
            text.classify_archive_family(F.col("x")), text.classify_program_family(F.col("x")), text.elf_architecture(F.col("x"))
        ).first()

    assert tuple(kinds(b"PK\3\4")) == ("APK", "JS", None)
    assert tuple(kinds(b"dex\n035\0")) == ("DEX", "JS", None)
    assert tuple(kinds(b"dex\n0351")) == (None, "JS", None)
    assert tuple(kinds(b"\x7fELF\1\1" + bytes(12) + b"\xb7\0"))[0::2] == ("ELF", "arm64-v8a")
    assert tuple(kinds(b"\x7fELF\1\2" + bytes(12) + b"\0\x03"))[0::2] == ("ELF", "x86")
    assert tuple(kinds(b"\x7fELF\2\3" + bytes(12) + b"\x03\x03"))[0::2] == ("ELF", None)
    assert tuple(kinds(b"MZ\0\0")) == (None, "PE", None)
    assert tuple(kinds(b"MZ")) == (None, None, None)


@pytest.mark.parametrize(("value", "want"), [("QUI=", b"AB"), ("QUI", None), ("QUJ=", None), ("QU I=", None), ("", b"")])
def test_strict_base64(spark, value, want):
    got = one(spark, value, text.strict_base64)
    assert (None if got is None else bytes(got)) == want
    assert codec.strict_base64(value) == want


def test_encoded_command(spark):
    mark = "powershell -WindowStyle Hidden -e "
    assert bytes(one(spark, f"x {mark}{B64} y", text.after_encoded_command)) == b"next stage"
    assert one(spark, f"x {mark}{B64}", text.after_encoded_command) is None
    assert one(spark, f"x {mark}nc {B64} y", text.after_encoded_command) is None
    assert one(spark, "nothing", text.after_encoded_command) is None


def test_quoted_and_numbered_payloads(spark):
    twice = base64.b64encode(B64.encode()).decode()
    assert bytes(one(spark, f"base64.b64decode(''''{B64}''')", text.quoted_payload)) == b"next stage"
    assert bytes(one(spark, f"base64.b64decode(base64.b64decode(r'''{twice}'''))", text.quoted_payload)) == b"next stage"
    assert one(spark, "base64.b64decode('''", text.quoted_payload) is None
    parts = "".join(f'set "base64_part{i}={c}"\n' for i, c in enumerate(B64))
    assert bytes(one(spark, parts + "base64.b64decode(x)", text.concat_payload)) == b"next stage"
    gap = parts.replace("part4=", "part99=")
    assert one(spark, gap, text.numbered_parts) == B64[:4]
    assert one(spark, 'set "base64_part0=abc', text.numbered_parts) is None
    assert one(spark, "none", text.numbered_parts) == ""


def test_a_quoted_payload_may_hold_nothing(spark):
    for script in ("b64decode('')", "b64decode('''''') base64.b64decode(x)", "b64decode(r'''''''), 'x'"):
        assert one(spark, f"base64.{script}", text.quoted_payload) == b""
    for script in ("b64decode('", "b64decode('''", "b64decode(''')", "b64decode('''''", "b64decode(''')'''), ''", "b64decode() '')"):
        assert one(spark, f"base64.{script}", text.quoted_payload) is None


def test_text_of_binary():
    assert codec.text_of(b"") == "" and codec.text_of(None) is None
    assert codec.text_of(b"a\xffb") == "a�b"
    assert codec.text_of("abc".encode("utf-16-le")) == "abc"
    assert codec.text_of(b"a\0" * 49 + b"ab") == "a\0" * 49 + "ab"  # exactly 98 %
    assert codec.text_of(b"a\0" * 99 + b"ab") == "a" * 99 + "扡"


def test_balanced_spans():
    mark = 'powershell -WindowStyle Hidden -Command "& {'
    assert codec.braced_command(f"{mark} a{{b}}c}} d") == "a{b}c"
    assert codec.braced_command(f"{mark} a{{b") == "a{"
    assert codec.braced_command(f"{mark} é}}") is None
    assert codec.braced_command("none") is None
    assert codec.array_literals("@(1,(2)) @( ) @(é) @(3 @(4))") == ["1,(2)", "3 @(4)", "4"]
    assert codec.array_literals("@(") == []


@pytest.mark.parametrize(
    ("expression", "value"), [("1+2*3", 7), ("(1+2)*3", 9), ("2^3^2", 512), ("-2^2", -4), ("7%4", 3), ("1/4", 0.25), ("-(3)", -3), ("2*-3", -6)]
)
def test_expressions(expression, value):
    assert codec.evaluate(expression) == value


@pytest.mark.parametrize("expression", ["", "1+", "(1", "1)", "1 2", "a", "1/0", "()", "__import__('os')"])
def test_bad_expressions(expression):
    with pytest.raises(ValueError):
        codec.evaluate(expression)


def test_characters():
    assert codec.characters_of("60+5, 2*33,999,-4") == "AB\xff\0"
    assert codec.characters_of("65,x") is None
    assert codec.decoded_literals("@(65) @(66,66) @(x) @(67,67)") == ["BB", "CC", "A"]


@given(st.text(), st.text(alphabet="abcXYZ019", min_size=1, max_size=12))
def test_xor_round_trip(value, key):
    if "\ud800" <= max(value, default="") <= "\udfff":
        return
    assert codec.unxor_gunzip(key, codec.xor_gzip(key, value)) == value


def test_xor_failures():
    assert codec.unxor_gunzip("k", "QUJD") is None and codec.unxor_gunzip("k", "*") is None and codec.unxor_gunzip(None, "") is None


def test_similarity(spark):
    assert one(spark, 0.0, text.similarity_to_distance, "double") == pytest.approx(99.68467076309885)
    assert one(spark, 100.0, text.similarity_to_distance, "double") == 0
    assert one(spark, "a/b/c.bin", text.parent_label) == "b" and one(spark, "c.bin", text.parent_label) is None


def test_literals_equal_a_scan_from_each_start():
    import random

    from loam.functions import codec

    def plain(text):
        found, at = [], text.find("@(")
        while at >= 0:
            end = codec._closing(text, at + 2, "(", ")")
            if end is not None and end > at + 2 and (inner := text[at + 2 : end - 1].strip()):
                found.append(inner)
            at = text.find("@(", at + 1)
        return found

    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("@((()) a1é") for _ in range(rng.randint(0, 14)))
        assert codec.array_literals(text) == plain(text)
    assert len(codec.array_literals("@(" * 20_000 + "é")) == 0


def test_xor_with_keys_of_any_length():
    from loam.functions import codec

    for key in ("k", "key", "a much longer key than the text itself, é"):
        assert codec.unxor_gunzip(key, codec.xor_gzip(key, "téxt")) == "téxt"
    assert codec.unxor_gunzip("", "QUJD") is None and codec.unxor_gunzip("k", None) is None


def test_a_payload_is_looked_for_once(spark, capsys):
    script = spark.createDataFrame([("x",)], "s string").select(F.concat("s", F.lit("y")).alias("s"))
    for f in (text.after_encoded_command, text.strict_base64, text.quoted_payload, spans.braced_command):
        script.select(f(F.upper("s")).alias("x")).explain()
        assert capsys.readouterr().out.count("upper(") == 1, f


def test_an_expression_that_repeats_is_evaluated_once(monkeypatch):
    calls = []
    monkeypatch.setattr(codec, "evaluate", lambda e, evaluate=codec.evaluate: calls.append(e) or evaluate(e))
    assert codec.characters_of("71+1,(71+1),71+1,1/0") is None and codec.characters_of("71+1,71+1,(71+1)") == "HHH"
    assert len(calls) <= 4
