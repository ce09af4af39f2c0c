"""Near-duplicate documents by bottom-k sketches of shingle sets from one hash function.

1. Each document becomes its set of shingle hashes, a digest of that set and the
   smallest hashes (the bottom-k sketch). Documents with equal sets form a class.
2. Inverted lists of retained values generate overlaps. Within a sketch the values
   are ordered from rare to frequent, by counts over all classes (the order changes
   cost only, never results). Two sets of Jaccard 0.8 have ``Level.shared`` retained
   values in common but for a probability below 1e-9, so they have ``OVERLAP`` values
   in common among the first ``size - shared + OVERLAP`` ones: only these are listed.
3. Short lists emit their pairs, which are kept if they share ``OVERLAP`` listed
   values and the union-sketch estimate allows the threshold. Long lists (common
   passages, large groups of copies) link to the list's first member.
4. What then is on a long list with members of another component goes through 2 and 3
   once more with wider sketches, which tell common passages from near copies. The
   little that still is on such a list is compared block by block, in bounded groups:
   on the wide sketches first, on full sets where these allow the threshold. A large
   group never becomes rows for all its pairs.
5. Every link is confirmed on full sets, and components follow from the links.

Set elements are 64-bit hashes; equality of sets rests on a 128-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField

from .components import connected_components
from .shared import drop_spooled, even_join, map_rows, narrow_input, scratch, small, spool
from .textscan import PowerTable, shingle_sets


class Level(NamedTuple):
    #: Values of a sketch.
    size: int
    #: Retained values in common that Jaccard 0.8 gives at least (binomial tails: 9e-10 and 6e-10).
    shared: int


NARROW, WIDE = Level(64, 30), Level(512, 352)
#: Listed values in common that a candidate from short lists needs.
OVERLAP = 6
#: Counts of frequent values that may go to the workers.
FREQUENT = 1 << 18
#: Longer lists don't emit pairs.
SHORT_LIST = 32
#: Long lists of a document, from the rarest on, whose first members it is compared with; the rest is left to step 4.
STARS = 4
#: Members of a block in the block-wise comparison, on average.
BLOCK = 256
#: A component of so many members is compared as a whole, not list by list.
LARGE = 64

_SIGN = np.uint64(1 << 63)


def signed(hashes: np.ndarray) -> np.ndarray:
    """Unsigned hashes as signed numbers of the same order, so that Spark sorts sketches as they were cut."""
    return (hashes ^ _SIGN).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    bounds = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(bounds, np.concatenate(arrays) if arrays else np.zeros(0, np.int64))


def _marks(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    powers = PowerTable()
    for batch in batches:
        sizes, digests, sketches = [], [], []
        for s in shingle_sets(batch.column(1), shingle, powers):
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            sketches.append(signed(s[: NARROW.size]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(sketches)],
            ["doc_id", "n", "digest", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    powers = PowerTable()
    for batch in batches:
        sets = list(shingle_sets(batch.column(1), shingle, powers))
        digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), digests, _lists([signed(s) for s in sets])], ["doc_id", "digest", "elements"])


def _jaccard_reaches(common: Column, n: Column, m: Column, threshold: tuple[int, int]) -> Column:
    return F.lit(threshold[1]) * common >= F.lit(threshold[0]) * (n + m - common)


def _sizes_allow(n: Column, m: Column, threshold: tuple[int, int]) -> Column:
    return F.lit(threshold[1]) * F.least(n, m) >= F.lit(threshold[0]) * F.greatest(n, m)


def _shared(held: Column, level: Level) -> Column:
    """Values in common that a sketch of so many values has with a partner's at least."""
    return F.least(F.lit(level.shared), F.ceil(held * 4 / 5))


def _ranked(batches: Iterator[pa.RecordBatch], level: Level, values: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        sketch = lists.flatten().to_numpy(zero_copy_only=False)
        lengths = np.diff(lists.offsets.to_numpy())
        rows = np.repeat(np.arange(len(lists)), lengths)
        at = np.minimum(np.searchsorted(values, sketch), max(len(values) - 1, 0))
        often = np.where(values[at] == sketch, counts[at], 0) if len(values) else np.zeros(len(sketch), np.int64)
        order = np.lexsort((sketch, often, rows))
        place = np.arange(len(sketch)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        shared = np.minimum(-(-4 * lengths // 5), level.shared)
        take = place < (lengths - shared + np.minimum(OVERLAP, shared))[rows]
        near = place < (lengths - shared + 1)[rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(sketch[order][take]), batch.column(0).take(pa.array(rows[take])), batch.column(1).take(pa.array(rows[take])), pa.array(near[take]), pa.array(place[take], pa.int32())],
            ["value", "node", "n", "near", "place"],
        )


def _listed(classes: DataFrame, level: Level) -> DataFrame:
    """``(value, node, n, near, place)``: the rarest sketch values of each class in order; ``near`` marks those that one common value would do for.

    Counts of values on more than ``SHORT_LIST`` sketches give the order. They go to the
    workers if there are ``FREQUENT`` at most, and through joins beyond.
    """
    values = classes.select("node", "n", F.explode("sketch").alias("value"))
    often = spool(values.groupBy("value").agg(F.count("*").alias("m")).where(F.col("m") > SHORT_LIST), "often")
    if often.limit(FREQUENT + 1).count() <= FREQUENT:
        found = often.toPandas().sort_values("value")
        held, counts = found["value"].to_numpy(np.int64), found["m"].to_numpy(np.int64)
        return classes.select("node", "n", "sketch").mapInArrow(
            lambda it: _ranked(it, level, held, counts), "value long, node long, n long, near boolean, place int"
        )
    ranked = (
        even_join(values, often, "value", by="node", how="left").groupBy("node", "n")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("m", F.lit(0)).alias("m"), "value"))).alias("ranked"))
    )
    held = F.size("ranked")
    shared = _shared(held, level)
    several = (held - shared + F.least(F.lit(OVERLAP), shared)).cast("int")
    return ranked.select("node", "n", (held - shared + 1).alias("single"), F.posexplode(F.slice("ranked", F.lit(1), several)).alias("place", "r")).select(
        F.col("r.value").alias("value"), "node", "n", (F.col("place") < F.col("single")).alias("near"), "place"
    )


def _candidates(classes: DataFrame, level: Level, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)`` from short lists and with the first members of long ones; long lists ``(value, node, n)``."""
    listed = spool(_listed(classes, level), "listed")
    long = spool(listed.groupBy("value").agg(F.count("*").alias("m")).where(F.col("m") > SHORT_LIST).select("value"), "long")
    long_lists = spool(even_join(listed, long, "value", by="node"), "long-lists")
    members = F.count("*").over(Window.partitionBy("value"))
    short = spool(listed.join(small(long), "value", "left_anti").withColumn("m", members).where("m > 1").select("value", "node", "n"), "short")
    drop_spooled(listed)

    # Values in common that long lists may hold count towards the overlap.
    elsewhere = spool(long_lists.groupBy("node").agg(F.count("*").alias("long"), F.min("place").alias("least")), "elsewhere")
    need = F.greatest(F.lit(1), F.least(F.lit(OVERLAP), _shared(F.least("n", F.lit(level.size)), level)) - F.coalesce("long", F.lit(0)))
    short = short.join(small(elsewhere), "node", "left").withColumn("need", need)
    one = short.select("value", F.col("node").alias("a"), F.col("n").alias("na"), F.col("need").alias("need_a"))
    two = short.select("value", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("need").alias("need_b"))
    pairs = (
        one.join(two, "value").where((F.col("a") < F.col("b")) & _sizes_allow(F.col("na"), F.col("nb"), threshold))
        .groupBy("a", "b").agg(F.count("*").alias("overlap"), F.min(F.least("need_a", "need_b")).alias("need"))
        .where("overlap >= need")
    )
    near = long_lists.where("near").select("value", "node", "n")
    # Members of a group share many lists, mostly with one first member: a few of them will do.
    few = even_join(long_lists.where("near"), elsewhere, "node", by="value").where(F.col("place") < F.col("least") + STARS).select("value", "node")
    pivots = near.groupBy("value").agg(F.min("node").alias("a"))
    stars = even_join(few, spool(pivots, "pivots"), "value", by="node").where("a < node").select("a", F.col("node").alias("b")).distinct()
    return pairs.select("a", "b").unionByName(stars).distinct(), near


def _estimated(pairs: DataFrame, classes: DataFrame, level: Level, threshold: tuple[int, int]) -> DataFrame:
    """Pairs whose union-sketch estimate is not below what Jaccard 0.8 gives at least.

    The margin is that of ``Level.shared``: under 30 of 64, or 352 of 512, common values of the union's sketch rule a pair out.
    """
    left = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    right = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, level.size)
    common = F.size(F.array_intersect(union, F.array_intersect("x", "y")))
    margin = 0.8 - (level.shared - 0.5) / level.size
    return (
        # A union of what is dealt alike keeps all its partitions, however few rows they hold.
        even_join(spool(pairs.hint("rebalance"), "candidates"), left, "a", by="b", wide=True).join(right, "b").where(_sizes_allow(F.col("na"), F.col("nb"), threshold))
        .where(common >= (threshold[0] / threshold[1] - margin) * F.size(union)).select("a", "b")
    )


def _verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return (
        even_join(pairs, left, "a", by="b", wide=True).join(right, "b")
        .where(_jaccard_reaches(common, F.size("x"), F.size("y"), threshold))
        .select("a", "b")
    )


def _placed(rows: DataFrame, components: DataFrame, node: str, component: str, by: str) -> DataFrame:
    """``rows`` with the component of ``node``, which is the node itself where no link has it."""
    homes = components.select(F.col("node").alias(node), F.col("component").alias("_home"))
    return even_join(rows, homes, node, by=by, how="left").withColumn(component, F.coalesce("_home", node)).drop("_home")


def _apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    placed = _placed(_placed(pairs, components, "a", "ca", "b"), components, "b", "cb", "a")
    return placed.where("ca <> cb").select("a", "b")


def _mixed(long_lists: DataFrame, components: DataFrame) -> DataFrame:
    """``(value, node, n, component)`` of the long lists whose members are in several components."""
    members = _placed(long_lists, components, "node", "component", "value")
    mixed = members.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("value")
    return spool(even_join(members, spool(mixed, "mixed"), "value", by="node"), "active")


def _dealt(active: DataFrame) -> DataFrame:
    """Members of mixed lists in blocks: ``(part, key, block_a, block_b, side, node, component)``.

    A component with many members meets each outsider that shares a list with it once,
    however many lists they share; the members of small components meet list by list.
    """
    homes = spool(active.select("node", "component").distinct(), "homes")
    sizes = homes.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= LARGE)
    active = even_join(active, spool(sizes, "sizes"), "component", by="node", how="left")
    large = active.where("size is not null").select("value", F.col("component").alias("home"), F.col("size").alias("home_size")).distinct()
    outsiders = spool(
        large.join(active, "value").where("component <> home and (size is null or component > home)")
        .select("home", "home_size", "node", "component").distinct(),
        "outsiders",
    )
    met = spool(outsiders.groupBy("home", "home_size").agg(F.count("*").alias("met")), "met")
    insiders = even_join(homes, met.withColumnRenamed("home", "component"), "component", by="node").withColumn("home", F.col("component"))
    blocks = {"a": F.ceil(F.col("home_size") / BLOCK), "b": F.ceil(F.col("met") / BLOCK)}
    own = lambda side: F.pmod(F.xxhash64("node"), blocks[side])
    every = lambda side: F.explode(F.sequence(F.lit(0).cast("long"), blocks[side] - 1))
    with_large = (
        insiders.select("home", "node", "component", own("a").alias("block_a"), every("b").alias("block_b"), F.lit(0).alias("side"))
        .unionByName(
            even_join(outsiders, met.select("home", "met"), "home", by="node")
            .select("home", "node", "component", every("a").alias("block_a"), own("b").alias("block_b"), F.lit(1).alias("side"))
        )
        .withColumnRenamed("home", "key")
    )

    loose = active.where("size is null").select("value", "node", "component")
    counts = loose.groupBy("value").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    pieces = F.ceil(F.col("m") / BLOCK)
    by_list = (
        even_join(loose, spool(counts.select("value", "m"), "counts"), "value", by="node")
        .select("value", "node", "component", F.pmod(F.xxhash64("node"), pieces).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("y"))
        .select(
            F.col("value").alias("key"), "node", "component", F.least("x", "y").alias("block_a"), F.greatest("x", "y").alias("block_b"),
            F.when(F.col("x") > F.col("y"), 1).otherwise(0).alias("side"),
        )
    )
    return with_large.withColumn("part", F.lit(0)).unionByName(by_list.withColumn("part", F.lit(1)))


def _common(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of values that each two lists have in common, and the lists' lengths."""
    lengths = np.diff(lists.offsets.to_numpy())
    rows = np.repeat(np.arange(len(lists)), lengths)
    _, column, often = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    # Only values of two members or more can be common ones.
    shared = often > 1
    renumbered = np.cumsum(shared) - 1
    keep = shared[column]
    rows, column = rows[keep], renumbered[column[keep]]
    common = np.zeros((len(lists), len(lists)), np.float32)
    for lo in range(0, int(shared.sum()), 4096):
        part = (column >= lo) & (column < lo + 4096)
        grid = np.zeros((len(lists), 4096), np.float32)
        grid[rows[part], column[part] - lo] = 1
        common += grid @ grid.T
    return common, lengths


def _opposite(table: pa.Table) -> np.ndarray:
    """Which members of a block meet: of different components, on different sides or in order on the first."""
    node, component, side = (table.column(c).to_numpy() for c in ("node", "component", "side"))
    return (component[:, None] != component[None, :]) & (side[:, None] == 0) & ((side[None, :] == 1) | (node[:, None] < node[None, :]))


def _list_column(table: pa.Table, name: str) -> pa.ListArray:
    lists = table.column(name).combine_chunks()
    return lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists


def _block_survivors(table: pa.Table, threshold: tuple[int, int]) -> pa.Table:
    """Members of a block that the sizes and wide sketches allow a link with another one."""
    common, held = _common(_list_column(table, "sketch"))
    n = table.column("n").to_numpy()
    least = np.minimum(held[:, None], held[None, :])
    allowed = _opposite(table) & (common >= np.minimum(WIDE.shared, -(-4 * least // 5)))
    allowed &= threshold[1] * np.minimum(n[:, None], n[None, :]) >= threshold[0] * np.maximum(n[:, None], n[None, :])
    return table.drop_columns(["sketch", "n"]).filter(pa.array(allowed.any(axis=0) | allowed.any(axis=1)))


def _block_links(table: pa.Table, threshold: tuple[int, int]) -> pa.Table:
    """Links between different components in one pair of blocks, on full sets."""
    common, lengths = _common(_list_column(table, "elements"))
    total = lengths[:, None] + lengths[None, :] - common
    node = table.column("node").to_numpy()
    a, b = np.nonzero(_opposite(table) & (threshold[1] * common >= threshold[0] * total) & (total > 0))
    return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64())})


def _across_components(active: DataFrame, classes: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links between members of a long list that are in different components so far."""
    block = ("part", "key", "block_a", "block_b")
    shape = "part int, key long, block_a long, block_b long, side int, node long, component long"
    names = [x.split()[0] for x in shape.split(", ")]
    survivors = (
        _dealt(active).join(classes.select("node", "n", "sketch"), "node").select(*names, "n", "sketch")
        .groupBy(*block).applyInArrow(lambda t: _block_survivors(t, threshold), shape)
    )
    return spool(survivors, "survivors").join(sets.select("node", "elements"), "node").groupBy(*block).applyInArrow(lambda t: _block_links(t, threshold), "a long, b long")


def _nodes(marks: DataFrame) -> DataFrame:
    """Classes ``(node, cid, digest, n, sketch)``, a node for each: its smallest id, or a number above all ids where that is another's."""
    classes = spool(
        marks.where("n > 0 and doc_id is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("cid"), F.first("n").alias("n"), F.first("sketch").alias("sketch")),
        "classes",
    )
    firsts = classes.groupBy("cid").agg(F.min("digest").alias("first"), F.count("*").alias("texts"))
    several = spool(firsts.where("texts > 1").select("cid", "first"), "several")
    if several.isEmpty():
        return classes.withColumn("node", F.col("cid"))
    above = classes.agg(F.max("cid")).first()[0]
    told = classes.join(small(several), "cid", "left").withColumn("node", F.when(F.col("first").isNull() | (F.col("first") == F.col("digest")), F.col("cid")))
    return spool(told.withColumn("node", F.coalesce("node", F.lit(above + 1) + F.monotonically_increasing_id())).drop("first"), "classes")


def _joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """The components once further links are there."""
    stars = components.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return spool(connected_components(stars.unionByName(links)), "components")


def _linked(source: DataFrame, marks: DataFrame, shingle: int, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The classes, and ``(node, component)`` of those with links; components are named by their least node."""
    classes = _nodes(marks)
    pairs, long_lists = _candidates(classes, NARROW, threshold)
    pairs = spool(_estimated(pairs, classes, NARROW, threshold), "pairs")
    long_lists = spool(long_lists, "lists")
    involved = (
        pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(long_lists.select("node")).distinct()
        .join(classes.select("node", "cid", "digest", "n"), "node")
    )
    owners = small(spool(involved.select(F.col("cid").alias("doc_id"), "digest", "node", "n"), "owners"))
    texts = source.where("doc_id is not null").join(owners.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = texts.mapInArrow(lambda it: _sets(it, shingle), "doc_id long, digest binary, elements array<long>").join(owners, ["doc_id", "digest"]).select("node", "n", "elements")
    if not marks.groupBy("doc_id").count().where("count > 1").isEmpty():
        # An id that stands on several rows with one text gives one set.
        sets = sets.groupBy("node").agg(F.first("n").alias("n"), F.first("elements").alias("elements"))
    sets = spool(sets, "sets")
    components = spool(connected_components(_verified(pairs, sets, threshold)), "components")
    active = _mixed(long_lists, components)
    if not active.isEmpty():
        wide = spool(sets.join(small(active.select("node").distinct()), "node", "left_semi").select("node", "n", F.slice("elements", 1, WIDE.size).alias("sketch")), "wide")
        again, rest = _candidates(wide, WIDE, threshold)
        again = spool(_estimated(_apart(again, components), wide, WIDE, threshold), "pairs")
        components = _joined(components, _verified(again, sets, threshold))
        active = _mixed(rest, components)
        if not active.isEmpty():
            components = _joined(components, _across_components(active, wide, sets, threshold))
    return classes, components


def _resolved(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """``(doc_id, n, digest, root, component)`` for every row; the root is null where a row has no class."""
    if 5 * threshold[0] < 4 * threshold[1]:
        raise ValueError("the sketches are sized for a Jaccard of 0.8 or more")
    source = narrow_input(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    with scratch() as keep:
        marks = keep(spool(
            source.mapInArrow(lambda it: _marks(it, shingle), "doc_id long, n long, digest binary, sketch array<long>"), "marks"
        ))
        classes, components = _linked(source, marks, shingle, threshold)
        homes = _placed(classes.select("node", "cid", "digest"), components, "node", "root", "cid")
        if classes.where("node <> cid").isEmpty():
            homes = homes.withColumn("component", F.col("root"))
        else:
            least = spool(homes.groupBy("root").agg(F.min("cid").alias("component")), "roots")
            homes = even_join(homes, least, "root", by="node")
        homes = keep(spool(homes.select("digest", "root", "component"), "homes"))
    told = marks.where("n > 0 and doc_id is not null").select("doc_id", "n", "digest")
    rest = marks.where("n = 0 or doc_id is null").select("doc_id", "n", "digest", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component"))
    return even_join(told, homes, "digest", by="doc_id", limit=100_000).select(rest.columns).unionByName(rest)


_KEPT = "coalesce(doc_id = component, true)"


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: tuple[int, int] = (80, 100)
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    Words are lower-cased (A-Z) runs other than space and 0x09-0x0D. Documents link
    if ``threshold[1] * intersection >= threshold[0] * union``, which must be a
    Jaccard of 0.8 or more. ``component_id`` is the smallest id reachable.

    Null or empty texts and texts without words have no shingles and link with
    nothing; shorter texts than a shingle are one shingle. Each row follows its own
    text, so an id with several texts may be in several components. A null id links
    with nothing: its component is null and it is kept. Very long texts are handled
    whole. Other columns are ignored; empty tables give no rows.
    """
    found = _resolved(docs, id_col, text_col, shingle, threshold)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.expr(_KEPT).alias("kept"))


#: A column name that no table has.
DIGEST = "_digest of the shingles"


def _with_digest(batches: Iterator[pa.RecordBatch], text_at: int, shingle: int) -> Iterator[pa.RecordBatch]:
    powers = PowerTable()
    for batch in batches:
        digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in shingle_sets(batch.column(text_at), shingle, powers)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], [*batch.schema.names, DIGEST])


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: tuple[int, int] = (80, 100)
) -> DataFrame:
    """``docs`` with one document of each group of near copies.

    Of a group the document with the smallest id stays, and of its rows one. Rows of an
    id with several texts are told apart by text. Rows without an id, and one row of each
    id without words, stay. Columns stay, whatever their names.
    """
    without = lambda df, ids, how="left_anti": df.join(ids, df[f"`{id_col}`"].cast("long") == ids["doc_id"], how)
    with scratch() as keep:
        found = spool(_resolved(docs, id_col, text_col, shingle, threshold).withColumn("kept", F.expr(_KEPT)), "near")
        by_id = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("kept").alias("some"))
        rest = without(docs, small(keep(spool(by_id.where("not some").select("doc_id"), "gone"))))
        repeated = keep(spool(by_id.where("some and rows > 1").select("doc_id"), "repeated"))
        if repeated.isEmpty():
            return rest
        again = small(repeated)
        stay = small(keep(spool(
            found.where("kept and doc_id is not null").join(again, "doc_id", "left_semi").groupBy("doc_id", "root").agg(F.min("digest").alias("digest")).select("doc_id", "digest"),
            "stay",
        )))
    at = docs.columns.index(text_col)
    several = map_rows(without(docs, again, "left_semi"), lambda it: _with_digest(it, at, shingle), StructField(DIGEST, BinaryType()))
    one = several.dropDuplicates([id_col, DIGEST])
    one = one.join(stay, (one[f"`{DIGEST}`"] == stay["digest"]) & (one[f"`{id_col}`"].cast("long") == stay["doc_id"]), "left_semi")
    return without(rest, again).unionByName(one.drop(F.col(f"`{DIGEST}`")))


#: For shingles of two words and a Jaccard of 0.8, as the registered query has them.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), elements AS (
  SELECT doc_id, unnest(s) AS e FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.s) + len(y.s) - c)
), ends AS (
  SELECT a AS i, b AS j FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id AS root, doc_id AS node FROM sets
  UNION SELECT r.root, n.j FROM reached r JOIN ends n ON n.i = r.node WHERE r.root < n.j
), components AS (
  SELECT node, min(root) AS component_id FROM reached GROUP BY node
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN components ON node = doc_id
"""
