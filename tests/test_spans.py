"""Spans by Columns and windows against the plain scanners, over many small texts of marks."""

import random

from loam.functions import codec, spans


def texts():
    rng = random.Random(4)
    alphabet = ["{", "}", "(", ")", "@(", "@", "a", " ", "\n", "\x1f", "é", "😀", "x(", "))"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    out += ["@(" * 3_000 + "x" + ")" * 2_990, "@(1,(2)) @( ) @(é) @(3 @(4))", "@(", "@()", ")(@(a)b", ""]
    return out


def test_braced_commands(spark):
    rng = random.Random(1)
    rows = [(i, (codec.COMMAND_MARK + rng.choice(["", " ", "{"]) if rng.random() < 0.9 else "") + t) for i, t in enumerate(texts())] + [(-1, None), (-2, codec.COMMAND_MARK)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "id long, t string").select("id", spans.braced_command("t")).collect()}
    assert got == {i: codec.braced_command(t) for i, t in rows}


def test_array_literals(spark):
    rows = [(i, 0, t) for i, t in enumerate(texts())] + [(1, 1, texts()[1]), (-1, 0, None)]
    found = spans.array_literals(spark.createDataFrame(rows, "id long, turn long, t string"), ["id", "turn"], "t")
    got = {(r[0], r[1]): r[2] for r in found.collect()}
    assert got == {(i, p): codec.array_literals(t) for i, p, t in rows}
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_pieces_go_without_their_text(spark):
    """A text of many marks isn't copied for each of them."""
    marks = "@(a(b)" * 3_000
    rows = spark.createDataFrame([(1, marks), (2, "@(x)")], "id long, t string")
    found = spans.array_literals(rows, ["id"], "t")
    assert {r[0]: r[1] for r in found.collect()} == {1: codec.array_literals(marks), 2: ["x"]}

    def nodes(plan):
        yield plan
        for k in range(plan.children().size()):
            yield from nodes(plan.children().apply(k))

    windows = [n.output().mkString(" ") for n in nodes(found._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Window"]
    assert len(windows) > 2 and not any("_text" in columns for columns in windows)
