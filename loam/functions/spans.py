"""Balanced spans without Python workers: depths as running sums over the marks of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.codec import COMMAND_MARK
from loam.functions.text import let

_FOREIGN = r"[^\x00-\x7f]"


def _ends(piece: Column, mark: str) -> Column:
    return F.endswith(piece, F.lit(mark))


def braced_command(text: Column) -> Column:
    """What the command block after the marker and one more character holds, as ``codec.braced_command``.

    The rest of the text is cut behind each brace, and the depth summed piece by piece
    until it is 0; an unclosed block runs to the text's end less one character.
    """
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("foreign"))

    def step(seen: Column, piece: Column) -> Column:
        depth = seen["depth"] + F.when(_ends(piece, "{"), 1).when(_ends(piece, "}"), -1).otherwise(0)
        foreign = piece.rlike(_FOREIGN)
        there = (seen["depth"] > 0) & ~seen["foreign"]
        return F.struct(
            F.when(there & ~foreign, depth).otherwise(seen["depth"]).alias("depth"),
            F.when(there & ~foreign, seen["length"] + F.length(piece)).otherwise(seen["length"]).alias("length"),
            F.when(there, foreign).otherwise(seen["foreign"]).alias("foreign"),
        )

    def inner(rest: Column) -> Column:
        seen = F.aggregate(F.split(rest, r"(?<=[{}])"), start, step)
        return let(seen, lambda s: F.when(~s["foreign"] & (s["length"] > 0), F.substr(rest, F.lit(1), s["length"] - 1)))

    def held(whole: Column) -> Column:
        at = F.instr(whole, COMMAND_MARK)
        return let(F.when(at > 0, F.substr(whole, at + F.lit(len(COMMAND_MARK) + 1))), inner)

    return let(text, held)


def array_literals(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``(keys, found)``: the contents of all ``@( )`` of each text, as ``codec.array_literals``; null texts give null.

    ``keys`` tell the rows apart. A text is cut behind each parenthesis and each non-ASCII
    character; the depth at a mark is the running sum of openings less closings, lifted by
    its least value so far where that is below 0. Marks of one depth open and close in turn, so
    an opening's partner is the next mark of its depth.
    """
    texts = rows.select(*keys, F.col(text_col).alias("_text"))
    # Pieces go without their text: a row of each with all of it would make a text's square.
    cut = texts.select(*keys, F.length("_text").alias("_size"), F.posexplode(F.split("_text", rf"(?<=[()]|{_FOREIGN})")).alias("_place", "_piece"))
    order = Window.partitionBy(*keys).orderBy("_place")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    piece = F.col("_piece")
    turn = F.when(_ends(piece, "("), 1).when(_ends(piece, ")"), -1).otherwise(0)
    told = cut.select(*keys, "_size", "_place", turn.alias("_turn"), _ends(piece, "@(").alias("_opens"), piece.rlike(_FOREIGN).cast("int").alias("_odd"), F.length(piece).alias("_length"))
    marks = (
        told.withColumns({"_sum": F.sum("_turn").over(until), "_end": F.sum("_length").over(until), "_foreign": F.sum("_odd").over(until)})
        .withColumn("_least", F.least(F.min("_sum").over(until), F.lit(0)))
        .withColumns({"_depth": F.col("_sum") - F.col("_least"), "_was": F.coalesce(F.lag(F.col("_sum") - F.col("_least")).over(order), F.lit(0))})
        .withColumns({"_all_foreign": F.max("_foreign").over(Window.partitionBy(*keys))})
        .where("_turn = 1 or (_turn = -1 and _was > 0)").withColumn("_level", F.greatest("_depth", "_was"))
    )
    same = Window.partitionBy(*keys, "_level").orderBy("_place")
    paired = marks.withColumns({"_close": F.lead("_end").over(same), "_close_foreign": F.lead("_foreign").over(same)}).where("_opens")
    last = F.greatest(F.col("_end"), F.col("_size") - 1)
    whole = F.coalesce("_close_foreign", "_all_foreign") == F.col("_foreign")
    spans = paired.where(whole).select(*keys, (F.col("_end") + 1).cast("int").alias("_start"), (F.coalesce(F.col("_close") - 1, last) - F.col("_end")).cast("int").alias("_long"))
    lists = spans.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_start", "_long"))).alias("_spans"))
    blank = r"[\x09-\x0D\x1C-\x20]+"
    inner = F.transform("_spans", lambda s: F.regexp_replace(F.substr("_text", s["_start"], s["_long"]), rf"\A{blank}|{blank}\z", ""))
    found = F.coalesce(F.filter(inner, lambda t: t != ""), F.array().cast("array<string>"))
    return texts.join(lists, keys, "left").select(*keys, F.when(F.col("_text").isNotNull(), found).alias("found"))
