"""Benchmark decontamination by pigeonhole edit matching.

A test item of length L that occurs in a text with at most E edits, when it is cut
into E + 1 pieces, has a piece that occurs unchanged (pigeonhole). All pieces of all
items form one automaton, which finds exact piece hits in one pass over each text.
Around each hit, Myers' bit-parallel algorithm verifies that the whole item occurs
within its error budget.

Items of more characters than one automaton should hold stay a table. A bit array of a
bounded size, made from hashes of all pieces, tells in one pass over the texts which
windows may be pieces; these meet the pieces in a join on their characters, and what is
around a hit meets its item in another one, to be verified there.

Texts and items are compared lower-cased, with every run of white space as one blank.
Items too short for an edit are found as whole words only.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import even_join, map_rows, narrow_input, spool
from .textscan import PowerTable, mix

#: One edit is allowed for so many characters of an item.
CHARS_PER_EDIT = 16
#: Characters of items in one automaton; more items are found by hashes of their pieces.
CHARS_PER_PASS = 2_000_000
#: Bits of the array that tells which windows of a text may be pieces: 16 a piece, at most 2**28 (32 MB).
BITS_PER_PIECE, MOST_BITS = 16, 28
#: Characters of texts that are hashed in one step; longer texts form a step of their own.
STEP_CHARS = 1 << 20
#: Items of fewer characters say too little to drop a document for.
LEAST_LEAK = 32


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    return length // chars_per_edit


def pieces(item: str, errors: int) -> Iterator[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length with their offsets."""
    for i in range(errors + 1):
        a, b = i * len(item) // (errors + 1), (i + 1) * len(item) // (errors + 1)
        yield a, item[a:b]


def myers(pattern_masks: dict[str, int], length: int, text: str, errors: int) -> tuple[int, int] | None:
    """The least distance of the pattern to a substring of ``text`` and that substring's end, if within ``errors``."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score, best, end = full, 0, length, errors + 1, -1
    for i, c in enumerate(text):
        eq = pattern_masks.get(c, 0)
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        h_plus = minus | (~(d0 | plus) & full)
        h_minus = plus & d0
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = (h_plus << 1) & full
        h_minus = (h_minus << 1) & full
        plus = h_minus | (~(d0 | h_plus) & full)
        minus = h_plus & d0
        if score < best:
            best, end = score, i + 1
    return (best, end) if end >= 0 else None


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


class Matcher:
    """Finds all items of a list that occur in a text within their budgets."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int = CHARS_PER_EDIT) -> None:
        self.items = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.errors = [budget(len(t), chars_per_edit) for _, t in self.items]
        self.masks: dict[int, dict[str, int]] = {}
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, t) in enumerate(self.items):
            for offset, piece in pieces(t, self.errors[k]):
                owners[piece].append((k, offset))
        for piece, where in owners.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str | None, first: bool = False) -> list[tuple[int, int]]:
        """``(item_id, distance)`` of every item that occurs, with its least distance, by item; of one item that occurs if only the ``first`` is asked for."""
        text = normal(text or "")
        if not text or not self.items:
            return []
        places: dict[int, list[int]] = defaultdict(list)
        for end, (length, where) in self.automaton.iter(text):
            for k, offset in where:
                places[k].append(end + 1 - length - offset)
        found: dict[int, int] = {}
        for k, starts in places.items():
            item_id, item = self.items[k]
            errors, size = self.errors[k], len(item)
            if not errors:
                if any(_whole(text, at, at + size) for at in starts):
                    found[item_id] = 0
                continue
            pattern = self.masks.get(k) or self.masks.setdefault(k, masks(item))
            starts.sort()
            best, covered = errors + 1, -1
            i = 0
            while i < len(starts) and best:
                # Windows of near starts are verified as one.
                lo, hi = max(0, starts[i] - errors), starts[i] + size + errors
                while i + 1 < len(starts) and starts[i + 1] - errors <= hi and hi - lo < 4 * size:
                    i += 1
                    hi = starts[i] + size + errors
                if hi > covered:
                    hit = myers(pattern, size, text[lo:hi], errors)
                    best, covered = min(best, hit[0] if hit else best), hi
                i += 1
            if best <= errors:
                found[item_id] = min(best, found.get(item_id, best))
                if first:
                    break
        return sorted(found.items())


def _whole(text: str, start: int, end: int) -> bool:
    """Whether no word runs on over either end."""
    before = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    after = end < len(text) and text[end - 1].isalnum() and text[end].isalnum()
    return not before and not after


def _hits(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]], chars_per_edit: int) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(items, chars_per_edit)
    for batch in batches:
        docs, hits, distances = [], [], []
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            for item_id, distance in matcher.find(text.as_py()):
                docs.append(doc_id.as_py())
                hits.append(item_id)
                distances.append(distance)
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(hits, pa.int64()), pa.array(distances, pa.int32())], ["doc_id", "item_id", "distance"]
        )


def _clean(batches: Iterator[pa.RecordBatch], text_at: int, items: list[tuple[int, str]], chars_per_edit: int) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(items, chars_per_edit)
    for batch in batches:
        yield batch.filter(pa.array([not matcher.find(t.as_py(), first=True) for t in batch.column(text_at)], pa.bool_()))


def _listed(items: DataFrame) -> list[tuple[int, str]] | None:
    """The items if one automaton can hold them, else None."""
    chars = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    return [tuple(r) for r in items.collect()] if chars <= CHARS_PER_PASS else None


def _tests(items: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return (
        narrow_input(items, item_id=item_col, text=item_text_col)
        .where("item_id is not null and text is not null").withColumn("item_id", F.col("item_id").cast("long")).distinct()
    )


def _normal_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([normal(t) for t in batch.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["item_id", "text"])


def _pieces(batches: Iterator[pa.RecordBatch], chars_per_edit: int) -> Iterator[pa.RecordBatch]:
    """A row a piece with its place in the bit array's two hashes."""
    powers = PowerTable()
    for batch in batches:
        rows = [
            (piece, item, offset, len(text), errors)
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for errors in [budget(len(text), chars_per_edit)] for offset, piece in pieces(text, errors)
        ]
        columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 5
        hashes = np.array([_window_hashes(_codes(p), len(p), powers)[0] for p in columns[0]], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)] + [pa.array(hashes.view(np.int64))],
            ["piece", "item", "offset", "size", "errors", "hash"],
        )


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _window_hashes(codes: np.ndarray, length: int, powers: PowerTable, sums: np.ndarray | None = None) -> np.ndarray:
    """A hash of every window of ``length`` characters, from prefix sums of a polynomial."""
    up, down = powers.upto(len(codes))
    sums = _prefix_sums(codes, up) if sums is None else sums
    n = max(len(codes) - length + 1, 0)
    return mix((sums[length : length + n] - sums[:n]) * down[:n] + np.uint64(length))


def _prefix_sums(codes: np.ndarray, up: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    return sums


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return hashes & mask, (hashes >> np.uint64(64 - MOST_BITS)) & mask


def _is_set(words: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (words[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) != 0


def _bit_array(found: DataFrame, bits: int) -> np.ndarray:
    """The slots of all hashes as bits of 64-bit words: at most ``2 ** MOST_BITS`` bits reach the driver."""
    mask = (1 << bits) - 1
    slots = F.array(F.col("hash").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("hash", 64 - MOST_BITS).bitwiseAND(F.lit(mask)))
    words = (
        found.select(F.explode(slots).alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    ).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _steps(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, chars = 0, 0
    for i, text in enumerate(texts):
        if i > start and chars + len(text) > STEP_CHARS:
            yield start, i
            start, chars = i, 0
        chars += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def _windows(batches: Iterator[pa.RecordBatch], words: object, bits: int, lengths: list[int]) -> Iterator[pa.RecordBatch]:
    """Texts with windows that may be pieces: ``(key, text, hits)``, a hit being the window, its start, and whether no word runs on over its ends."""
    powers, array = PowerTable(), words.value
    for batch in batches:
        keys, texts = batch.column(0), [normal(t or "") for t in batch.column(1).to_pylist()]
        for a, b in _steps(texts):
            # No text has a line break any more, so no window of a piece runs from one into the next.
            joined = "\n".join(texts[a:b])
            codes = _codes(joined)
            sums = _prefix_sums(codes, powers.upto(len(codes))[0])
            begins = np.array(list(accumulate((len(t) + 1 for t in texts[a : b - 1]), initial=0)))
            hits: dict[int, list[tuple[str, int, bool]]] = defaultdict(list)
            for length in lengths:
                first, second = _slots(_window_hashes(codes, length, powers, sums), bits)
                at = np.flatnonzero(_is_set(array, first))
                at = at[_is_set(array, second[at])]
                for p, row in zip(at.tolist(), (np.searchsorted(begins, at, side="right") - 1).tolist(), strict=True):
                    hits[row].append((joined[p : p + length], p - int(begins[row]), _whole(joined, p, p + length)))
            rows = sorted(hits)
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array([a + r for r in rows], pa.int64())), pa.array([texts[a + r] for r in rows], pa.string()),
                    pa.array([[dict(zip(("piece", "at", "whole"), h, strict=True)) for h in hits[r]] for r in rows], _HITS),
                ],
                ["key", "text", "hits"],
            )


_HITS = pa.list_(pa.struct([("piece", pa.string()), ("at", pa.int32()), ("whole", pa.bool_())]))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances of items in the windows around their pieces, where they are within budget."""
    known = lru_cache(10_000)(masks)
    for batch in batches:
        rows, distances = [], []
        columns = (batch.column(c).to_pylist() for c in ("pattern", "window", "errors"))
        for i, (pattern, window, errors) in enumerate(zip(*columns, strict=True)):
            if hit := myers(known(pattern), len(pattern), window, errors):
                rows.append(i)
                distances.append(hit[0])
        kept = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column("key"), kept.column("item"), kept.column("uid"), pa.array(distances, pa.int32())], ["key", "item", "uid", "distance"])


def _by_hashes(texts: DataFrame, tests: DataFrame, chars_per_edit: int, least: int = 1) -> DataFrame:
    """``(key, item_id, distance)`` of the items in ``texts`` of ``(key, text)``, however many items there are.

    Items of equal normalised text are one. The texts are read once; those with windows
    that may be pieces are written with these. A window of a text is verified once for
    each item and each stretch as long as the item.
    """
    ids = spool(
        tests.mapInArrow(_normal_items, "item_id long, text string").where(F.length("text") >= least).withColumn("item", F.md5("text")), "items"
    )
    items = ids.select("item", F.col("text").alias("pattern")).dropDuplicates(["item"])
    found = spool(
        items.mapInArrow(partial(_pieces, chars_per_edit=chars_per_edit), "piece string, item string, offset int, size int, errors int, hash long"), "pieces"
    )
    figures = found.agg(F.count("*"), F.collect_set(F.length("piece"))).first()
    bits = min(MOST_BITS, max(16, (BITS_PER_PIECE * figures[0]).bit_length()))
    words = texts.sparkSession.sparkContext.broadcast(_bit_array(found, bits))
    name = texts.schema["key"].dataType.simpleString()
    near = texts.mapInArrow(
        partial(_windows, words=words, bits=bits, lengths=sorted(figures[1])), f"key {name}, text string, hits array<struct<piece:string,at:int,whole:boolean>>"
    )
    # Numbered as they are written: what is read again has the same numbers.
    near = spool(near.withColumn("uid", F.monotonically_increasing_id()), "near")
    hits = near.select("uid", "key", F.explode("hits").alias("hit")).select("uid", "key", "hit.*")
    met = even_join(hits, found.drop("hash"), "piece", "uid").where("errors > 0 or whole")
    spots = spool(
        met.select("uid", "key", "item", "size", "errors", F.when(F.col("errors") > 0, F.expr("floor((at - offset) / size)")).otherwise(0).cast("long").alias("stretch")).distinct(),
        "spots",
    )
    begin = F.col("stretch") * F.col("size") - F.col("errors")
    windows = spots.where("errors > 0").join(near.select("uid", "text"), "uid").select(
        "uid", "key", "item", "errors", _cut("text", begin, begin + 2 * F.col("size") + 2 * F.col("errors")).alias("window")
    )
    verified = even_join(windows, items, "item", "uid", wide=True).mapInArrow(_verified, f"key {name}, item string, uid long, distance int")
    exact = spots.where("errors = 0").select("key", "item", "uid", F.lit(0).alias("distance"))
    return (
        even_join(spool(exact.unionByName(verified), "found"), ids.select("item", "item_id"), "item", "uid")
        .groupBy("key", "item_id").agg(F.min("distance").alias("distance"))
    )


def _cut(text: str, begin: Column, end: Column) -> Column:
    """Characters of ``text`` from ``begin``, or its start, to before ``end``."""
    first = F.greatest(begin, F.lit(0))
    return F.substring(F.col(text), (first + 1).cast("int"), (end - first).cast("int"))


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", chars_per_edit: int = CHARS_PER_EDIT,
) -> DataFrame:
    """``(doc_id, item_id, distance)`` of every item that occurs in a document within its budget.

    The budget is one edit per ``chars_per_edit`` characters of the normalised item; an
    item too short for an edit occurs where it stands as whole words. Very long texts
    are searched whole. Null or empty texts and items match nothing; repeated rows of a
    document or of an item count once, and of several texts of an item the least distance;
    documents or items without an id take no part; other columns are ignored; if either
    table is empty, there are no rows. Items of up to ``CHARS_PER_PASS`` characters are on
    the driver and in the workers; more stay a table, and of them only a bit array is.
    """
    source = narrow_input(docs, doc_id=id_col, text=text_col).where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    tests = _tests(items, item_col, item_text_col)
    if (held := _listed(tests)) is None:
        return _by_hashes(source.withColumnRenamed("doc_id", "key"), tests, chars_per_edit).withColumnRenamed("key", "doc_id")
    schema = "doc_id long, item_id long, distance int"
    if not held:
        return docs.sparkSession.createDataFrame([], schema)
    found = source.mapInArrow(lambda it: _hits(it, held, chars_per_edit), schema)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    chars_per_edit: int = CHARS_PER_EDIT, least: int = LEAST_LEAK,
) -> DataFrame:
    """``docs`` without the rows in whose text an item of ``least`` characters or more occurs within its budget.

    Each row follows its own text, with or without an id, repeated or not; null and empty
    texts stay; columns stay, whatever their names.
    """
    tests = _tests(items, item_col, item_text_col).where(F.length(F.trim("text")) >= least)
    if (held := _listed(tests)) is None:
        return _without(docs, text_col, lambda texts: _by_hashes(texts, tests, chars_per_edit, least))
    at = docs.columns.index(text_col)
    held = [(i, t) for i, t in held if len(normal(t)) >= least]
    return map_rows(docs, lambda it: _clean(it, at, held, chars_per_edit)) if held else docs


def _without(docs: DataFrame, text_col: str, match: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` without the rows whose text's digest ``match`` finds; the texts themselves aren't written again."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    key = F.sha2(plain[f"c{docs.columns.index(text_col)}"].cast("binary"), 256)
    texts = narrow_input(docs, text=text_col).where("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("key"), "text")
    bad = spool(match(texts).select("key").distinct().withColumn("bad", F.lit(True)), "bad")
    # Any deal of a digest's rows over pieces is right; that by partition costs nothing.
    marked = even_join(plain.withColumns({"key": key, "dealt": F.spark_partition_id()}), bad, "key", "dealt", "left")
    return marked.where("bad is null").select(*plain.columns).toDF(*docs.columns)
