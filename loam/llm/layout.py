"""A multidimensional clustered layout with a hierarchical min-max zone map.

Rows are ordered by a z-value that interleaves the digits of their coordinates, cut into
files of a fixed number of rows, and a segment tree over consecutive files keeps the
ranges of the coordinates of each subtree. A query, a box of coordinates, descends from
the root: disjoint subtrees are pruned, subtrees within the box are added whole, the
others are opened, down to single files, whose list of cells tells whether a row matches.

Nothing that grows with the rows passes through one task, the driver or a broadcast:
ranks are prefix sums over sorted partitions, the boundaries of the coordinates and the
queries are as few as there are cells, and the tree is a table that is joined level by
level, by sorting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import narrow_input, spool

#: Digits of a coordinate: 8 cells a dimension, 4,096 cells in all.
DIGITS = 3
CELLS = 1 << DIGITS
#: Dimensions in the order of their digits.
DIMENSIONS = ("source", "lang", "length", "date")
#: How far a query reaches to both sides of its row's coordinate.
REACH = {"source": 0, "lang": 0, "length": 1, "date": 1}
FILE_ROWS = 1_000
DAYS = 365
#: Children of a node of the tree.
FAN = 8


def _sortable(name: str) -> Column:
    """A value as text whose order by bytes is that of the values, null first."""
    value = F.col(name)
    return F.coalesce(F.concat(F.lit("v"), value if name in ("source", "lang") else F.lpad((value + 1).cast("string"), 20, "0")), F.lit(""))


def _in_order(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` sorted by ``keys`` over partitions and written, with ``bucket``, the partition, and ``place``, the row's number in it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    return spool(placed.withColumns({"bucket": F.shiftright("_at", 33), "place": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at"), name)


def _offsets(sums: DataFrame, *by: str) -> DataFrame:
    """``(by, bucket, offset)`` from sums by bucket: at most a row a partition and group of ``by``."""
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")


def cell_starts(rows: DataFrame) -> dict[str, list[tuple[int, str]]]:
    """For each dimension the coordinates that occur, each with the least value (as ``_sortable``) that has it.

    A value's coordinate is ``floor(CELLS * s / n)``: ``s`` of the ``n`` rows have a smaller value.
    """
    values = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), _sortable(d).alias("value")) for d in DIMENSIONS)))
    counted = rows.select("n", values.alias("v")).groupBy("v.dimension", "v.value").agg(F.sum("n").alias("n"))
    placed = _in_order(counted, ["dimension", "value"], "values")
    sums = placed.groupBy("dimension", "bucket").agg(F.sum("n").alias("n"))
    inside = Window.partitionBy("dimension", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    smaller = (
        placed.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(_offsets(sums, "dimension"), ["dimension", "bucket"])
        .join(F.broadcast(sums.groupBy("dimension").agg(F.sum("n").alias("total"))), "dimension")
    )
    cell = F.expr(f"cast(({CELLS} * (offset + inside)) div total as int)")
    starts = smaller.withColumn("cell", cell).groupBy("dimension", "cell").agg(F.min("value").alias("start"))
    found: dict[str, list[tuple[int, str]]] = {d: [] for d in DIMENSIONS}
    for r in starts.collect():  # a row a cell and dimension, 32 at most
        found[r["dimension"]].append((r["cell"], r["start"]))
    return {d: sorted(s) for d, s in found.items()}


def _cell(name: str, starts: list[tuple[int, str]]) -> Column:
    out, value = F.lit(0), _sortable(name)
    for cell, start in starts:
        out = F.when(value >= start, cell).otherwise(out)
    return out.cast("int")


def interleaved(cells: list[Column]) -> Column:
    """The digits of the coordinates in turn, highest first."""
    out, place = F.lit(0), DIGITS * len(cells) - 1
    for digit in range(DIGITS - 1, -1, -1):
        for c in cells:
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c, digit).bitwiseAND(1), place))
            place -= 1
    return out.cast("int")


def place_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, source, lang, length, date, z, position, file)``, one row per row; the four values as coordinates.

    A null text has length -1; a null id has a null date, which like a null source or
    language is smaller than all others, and comes first among equal z. Rows that agree
    in all values take successive positions.
    """
    text = F.col("text")
    narrow = narrow_input(docs, doc_id=id_col, text=text_col, source=source_col, lang=lang_col).select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.coalesce(F.octet_length(text), F.lit(-1)).cast("long").alias("length")
    )
    # Rows that repeat are one row with a count until the end, so that none of them fills a task.
    rows = spool(narrow.groupBy("doc_id", "source", "lang", "length").agg(F.count("*").alias("n")), "rows").withColumn(
        "date", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % DAYS).cast("long")
    )
    starts = cell_starts(rows)
    cells = rows.select("doc_id", "n", *(_cell(d, starts[d]).alias(d) for d in DIMENSIONS)).withColumn("z", interleaved([F.col(d) for d in DIMENSIONS]))
    each = cells.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    placed = _in_order(each, ["z", "doc_id", "copy"], "places")
    offsets = _offsets(placed.groupBy("bucket").agg(F.count("*").alias("n")))
    position = F.col("offset") + F.col("place")
    return placed.join(F.broadcast(offsets), "bucket").select(
        "doc_id", *DIMENSIONS, F.col("z").cast("long"), position.alias("position"), F.floor(position / FILE_ROWS).cast("long").alias("file")
    )


def zone_map(placed: DataFrame) -> list[DataFrame]:
    """The levels of the segment tree, files first, the root last: ``(node, files, <dimension>_low, <dimension>_high)``."""
    ranges = [f(d).alias(f"{d}_{end}") for d in DIMENSIONS for f, end in ((F.min, "low"), (F.max, "high"))]
    levels = [spool(placed.groupBy(F.col("file").alias("node")).agg(F.lit(1).cast("long").alias("files"), F.collect_set("z").alias("cells"), *ranges), "files")]
    width = (levels[0].agg(F.max("node")).first()[0] or 0) + 1
    merged = [f(f"{d}_{end}").alias(f"{d}_{end}") for d in DIMENSIONS for f, end in ((F.min, "low"), (F.max, "high"))]
    while width > 1:
        above = levels[-1].groupBy(F.floor(F.col("node") / FAN).cast("long").alias("node")).agg(F.sum("files").alias("files"), *merged)
        levels.append(spool(above, "zones"))
        width = -(-width // FAN)
    return levels


def _digits(z: Column, dimension: int) -> Column:
    """The coordinate of a dimension from a z-value."""
    out = F.lit(0)
    for digit in range(DIGITS):
        place = digit * len(DIMENSIONS) + len(DIMENSIONS) - 1 - dimension
        out = out.bitwiseOR(F.shiftleft(F.shiftright(z, place).bitwiseAND(1), digit))
    return out


def box(cell: Column) -> list[Column]:
    """The bounds of the query around a cell, both inclusive."""
    return [(_digits(cell, i) + side * REACH[d]).alias(f"{d}_{name}") for i, d in enumerate(DIMENSIONS) for side, name in ((-1, "from"), (1, "to"))]


def descend(queries: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``(cell, files_touched, files_matching)`` for boxes ``(cell, <dimension>_from, <dimension>_to)``.

    Each level takes the subtrees that the level above left open: as many as there are
    pairs of a query and a node that crosses its border, however many rows a node has.
    """
    sides = [f"{d}_{end}" for d in DIMENSIONS for end in ("from", "to")]
    meets, within = F.lit(True), F.lit(True)
    for d in DIMENSIONS:
        low, high, start, end = (F.col(f"{d}_{x}") for x in ("low", "high", "from", "to"))
        meets, within = meets & (low <= end) & (high >= start), within & (low >= start) & (high <= end)
    open_nodes = queries.withColumn("node", F.lit(0).cast("long"))
    found = []
    for depth in range(len(levels) - 1, -1, -1):
        met = spool(open_nodes.join(levels[depth].hint("merge"), "node").where(meets).withColumn("whole", within).select("cell", *sides, "node", "files", "whole", *(["cells"] if not depth else [])), "met")
        whole = met.where("whole").select("cell", F.col("files").alias("touched"), F.col("files").alias("matching"))
        found.append(whole)
        rest = met.where("not whole")
        if depth:
            children = F.explode(F.sequence(F.col("node") * FAN, F.col("node") * FAN + FAN - 1))
            open_nodes = rest.select("cell", *sides, children.alias("node"))
        else:
            inside = F.exists("cells", lambda z: _inside(z))
            found.append(rest.select("cell", "files", inside.alias("hit")).select("cell", F.col("files").alias("touched"), F.col("hit").cast("long").alias("matching")))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every.groupBy("cell").agg(F.sum("touched").alias("files_touched"), F.sum("matching").alias("files_matching"))


def _inside(z: Column) -> Column:
    out = F.lit(True)
    for i, d in enumerate(DIMENSIONS):
        at = _digits(z, i)
        out = out & (at >= F.col(f"{d}_from")) & (at <= F.col(f"{d}_to"))
    return out


def clustered_layout(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, z, position, file, files_touched, files_matching, file_bounds)``, one row per row.

    As in ``place_rows`` for nulls and repeated rows; texts count by their whole length;
    other columns are ignored; an empty table gives no rows.
    """
    placed = place_rows(docs, id_col, text_col, source_col, lang_col)
    levels = zone_map(placed)
    cells = placed.select(F.col("z").alias("cell")).distinct()  # CELLS ** 4 at most, however many rows there are
    counts = descend(cells.select("cell", *box(F.col("cell"))), levels).withColumnRenamed("cell", "z")
    bounds = levels[0].select(F.col("node").alias("file"), F.concat_ws(",", *(f"{d}_{end}" for d in DIMENSIONS for end in ("low", "high"))).alias("file_bounds"))
    return placed.join(bounds.hint("merge"), "file").join(F.broadcast(counts), "z").select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds")


ORACLE_SQL = r"""
WITH RECURSIVE tbl(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM tbl WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS entries FROM tbl WHERE k = 8
), texts AS (
  SELECT doc_id, coalesce(source, '') AS source, source IS NOT NULL AS has_source, coalesce(lang, '') AS lang, lang IS NOT NULL AS has_lang,
         coalesce(strlen(text), -1)::BIGINT AS length, [0::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT) AS bytes
  FROM documents
), valued AS (
  SELECT doc_id, source, has_source, lang, has_lang, length,
         xor(list_reduce([4294967295::UBIGINT] || bytes[2:], lambda acc, b: xor(acc >> 8, entries[((xor(acc, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 365 AS date
  FROM texts CROSS JOIN crc_table
), cells AS (
  SELECT doc_id,
         (8 * (rank() OVER (ORDER BY has_source, source) - 1)) // count(*) OVER () AS s,
         (8 * (rank() OVER (ORDER BY has_lang, lang) - 1)) // count(*) OVER () AS l,
         (8 * (rank() OVER (ORDER BY length) - 1)) // count(*) OVER () AS n,
         (8 * (rank() OVER (ORDER BY date NULLS FIRST) - 1)) // count(*) OVER () AS d
  FROM valued
), coded AS (
  SELECT *, (((s >> 2) & 1) << 11) | (((l >> 2) & 1) << 10) | (((n >> 2) & 1) << 9) | (((d >> 2) & 1) << 8)
         | (((s >> 1) & 1) << 7) | (((l >> 1) & 1) << 6) | (((n >> 1) & 1) << 5) | (((d >> 1) & 1) << 4)
         | ((s & 1) << 3) | ((l & 1) << 2) | ((n & 1) << 1) | (d & 1) AS z
  FROM cells
), placed AS (
  SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position, (row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1) // 1000 AS file FROM coded
), files AS (
  SELECT file, min(s) AS s0, max(s) AS s1, min(l) AS l0, max(l) AS l1, min(n) AS n0, max(n) AS n1, min(d) AS d0, max(d) AS d1 FROM placed GROUP BY file
), queries AS (
  SELECT DISTINCT s, l, n, d, z FROM placed
), held AS (
  SELECT DISTINCT file, s, l, n, d FROM placed
), touched AS (
  SELECT z, count(*) AS files_touched FROM queries q JOIN files f
    ON q.s BETWEEN s0 AND s1 AND q.l BETWEEN l0 AND l1 AND n0 <= q.n + 1 AND n1 >= q.n - 1 AND d0 <= q.d + 1 AND d1 >= q.d - 1
  GROUP BY z
), matching AS (
  SELECT q.z, count(DISTINCT h.file) AS files_matching FROM queries q JOIN held h
    ON q.s = h.s AND q.l = h.l AND h.n BETWEEN q.n - 1 AND q.n + 1 AND h.d BETWEEN q.d - 1 AND q.d + 1
  GROUP BY q.z
)
SELECT doc_id, p.z::BIGINT AS z, position::BIGINT AS position, p.file::BIGINT AS file, files_touched::BIGINT AS files_touched, files_matching::BIGINT AS files_matching,
       concat_ws(',', s0, s1, l0, l1, n0, n1, d0, d1) AS file_bounds
FROM placed p JOIN files f ON p.file = f.file JOIN touched t ON p.z = t.z JOIN matching m ON p.z = m.z
"""
