"""Mixing sources to target weights by a time-varying curriculum, with DataFrame functions only.

Each source has a weight and a drift: its share of attention at time t in [0, 1] is
``1 + drift * (2t - 1)`` times its mean. The integral of that schedule is the share of
its target that the training run has taken by time t. A source's documents, in a fixed
pseudo-random order and repeated in further passes, demand its tokens one after the
other; inverting the integral at a document's cumulative demand gives its training
position, and a range sort by position gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small, spool, word_count

#: Weights of the sources in order, repeated.
WEIGHTS = (3, 1, 2)
#: Drifts of the sources in order, repeated; all within [-1, 1].
DRIFTS = (0.5, -0.5, 0.0)
#: Words to take, in units of all words: numerator and denominator.
SHARE = (3, 2)
#: A document is taken at most so many times.
PASSES = 2
#: Buckets whose figures are broadcast at most (some 40 MB).
FIGURES = 200_000
#: Hexadecimal digits of a document's order key that name its bucket: 4096 buckets a source.
BUCKET_DIGITS = 3


def _cycle(values: tuple, place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (place % len(values) + 1).cast("int"))


def source_targets(sized: DataFrame) -> DataFrame:
    """``(source, source_size, weight, drift, target)`` from rows ``(source, size)``.

    Targets share the words to take by weight; a target stops at ``PASSES`` times its
    source's size, and what is over is shared anew by weight. In the end all sources
    below their limit get the same words per weight, so with sources sorted by limit
    per weight that level follows from running sums over the sources alone.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sums.withColumn("place", place).select(
        "source", "source_size", _cycle(WEIGHTS, F.col("place")).cast("long").alias("weight"), _cycle(DRIFTS, F.col("place")).alias("drift")
    )
    whole = Window.partitionBy()
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = sources.withColumns(
        {
            "capped": F.coalesce(F.sum("source_size").over(by_limit), F.lit(0)),
            "open_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_limit), F.lit(0)),
            "total": F.sum("source_size").over(whole),
        }
    )
    # Words left for the sources from this one on, if all before it are at their limits; in units of 1 / SHARE[1].
    left = F.lit(SHARE[0]) * F.col("total") - F.lit(SHARE[1] * PASSES) * F.col("capped")
    free = F.lit(SHARE[1] * PASSES) * F.col("source_size") * F.col("open_weight") > left * F.col("weight")
    level = before.withColumns({"left": left, "free": free})
    first = F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), F.col("left"), F.col("open_weight")))).over(whole)
    return level.withColumn("first", first).select(
        "source", "source_size", "weight", "drift",
        F.when(
            F.col("free"),
            F.col("weight").cast("double") * F.col("first.left").cast("double") / (F.lit(SHARE[1]) * F.col("first.open_weight")).cast("double"),
        ).otherwise((F.lit(PASSES) * F.col("source_size")).cast("double")).alias("target"),
    )


def schedule_inverse(share: Column, drift: Column) -> Column:
    """The time t with ``(1 - drift) t + drift t^2 = share``."""
    b = 1 - drift
    root = F.sqrt(F.greatest(b * b + 4 * drift * share, F.lit(0.0)))
    return F.when(share <= 0, 0.0).when(drift == 0, share).otherwise(2 * share / (b + root))


def _order_key(id_col: Column, text: Column) -> Column:
    """The place of a document in its source's order: a digest of its id, or of its text where it has none."""
    return F.md5(F.coalesce(id_col.cast("long").cast("string"), text, F.lit("")).cast("binary"))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``(doc_id, source, size, key)``, written once, so that the texts are read once for all that follows from sizes."""
    text, name = docs[f"`{text_col}`"], docs[f"`{id_col}`"]
    return spool(
        docs.select(name.cast("long").alias("doc_id"), docs[f"`{source_col}`"].cast("string").alias("source"), word_count(text).alias("size"), _order_key(name, text).alias("key")),
        "sizes",
    )


def _demands(sized: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with their source's figures and the words demanded before them, in passes of their source.

    ``sized`` and ``rows`` have ``(doc_id, source, size, key)`` of the same documents.
    """
    in_bucket = F.substring("key", 1, BUCKET_DIGITS)
    # Prefix sums in two levels, so that no source has to pass through one task.
    buckets = spool(sized.groupBy("source", in_bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size")), "buckets")
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(up_to), F.lit(0)).alias("offset"))
    targets = source_targets(buckets.select("source", F.col("bucket_size").alias("size")))
    figures = offsets.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    figures = spool(figures.withColumnsRenamed({"source": "s", "bucket": "b"}), "figures")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("bucket", in_bucket).withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(small(figures, FIGURES), (F.col("bucket") == F.col("b")) & F.col("source").eqNullSafe(F.col("s")))
        .withColumn("before", F.col("offset") + F.col("within")).drop("s", "b", "key", "bucket", "within", "offset")
        .withColumn("words", F.round("target").cast("long"))
    )


def _taken(before: Column) -> Column:
    """Words of a document that the mix takes, if ``before`` words of its source come first."""
    return F.greatest(F.lit(0), F.least("size", F.col("words") - before)).cast("long")


def _position(before: Column) -> Column:
    return schedule_inverse(F.when(F.col("target") > 0, before / F.col("target")).otherwise(1.0), F.col("drift"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, size, source_size, target, taken, position)``, a row per row, sorted by position.

    The size is the number of words, 0 for a null text; a null source is a source and
    comes last; rows without an id order by their text; rows that agree in id (or text
    without one) and size are taken in any order; very long texts count whole; documents
    that the mix doesn't take have a null position and come last. Other columns are
    ignored; an empty table gives no rows.
    """
    sized = _sizes(docs, id_col, text_col, source_col)
    rows = _demands(sized, sized)
    passes = [_taken(F.col("before") + i * F.col("source_size")) for i in range(PASSES)]
    taken = sum(passes[1:], passes[0])
    return rows.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), F.when(taken > 0, _position(F.col("before"))).alias("position")
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The training order: a row for each pass in which the mix takes words of a document.

    Columns of ``docs`` stay; ``mix_pass``, ``mix_taken`` (words, from the text's start)
    and ``mix_position`` come on top, in place of any so named, and rows are range-sorted
    by position. Rows that share an id come in the order of their texts' digests, so that
    reruns agree.
    """
    own = ("mix_pass", "mix_taken", "mix_position")
    name, text = docs[f"`{id_col}`"], docs[f"`{text_col}`"]
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns if c.lower() not in own)).alias("row")
    held = docs.select(
        name.cast("long").alias("doc_id"), docs[f"`{source_col}`"].cast("string").alias("source"), word_count(text).alias("size"),
        F.concat(_order_key(name, text), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("key"), whole,
    )
    rows = _demands(_sizes(docs, id_col, text_col, source_col), held)
    passes = rows.withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))))
    before = F.col("before") + F.col("mix_pass") * F.col("source_size")
    return (
        passes.select("row", "mix_pass", _taken(before).alias("mix_taken"), _position(before).alias("mix_position"))
        .where("mix_taken > 0").select("row.*", *own).orderBy("mix_position", "mix_pass")
    )


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, text, '')) AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
), sources AS (
  SELECT source, source_size, (CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::BIGINT AS weight,
         CASE place % 3 WHEN 0 THEN 0.5 WHEN 1 THEN -0.5 ELSE 0.0 END::DOUBLE AS drift
  FROM sums
), levels AS (
  SELECT a.source, a.source_size, a.weight, a.drift,
         3 * (SELECT sum(source_size) FROM sources) - 4 * coalesce(sum(b.source_size), 0) AS rest,
         (SELECT sum(weight) FROM sources) - coalesce(sum(b.weight), 0) AS open_weight
  FROM sources a LEFT JOIN sources b
    ON b.source_size::DOUBLE / b.weight < a.source_size::DOUBLE / a.weight
    OR (b.source_size::DOUBLE / b.weight = a.source_size::DOUBLE / a.weight AND (b.source < a.source OR (a.source IS NULL AND b.source IS NOT NULL)))
  GROUP BY ALL
), free AS (
  SELECT *, 4 * source_size * open_weight > rest * weight AS is_free FROM levels
), level AS (
  SELECT rest, open_weight FROM free WHERE is_free ORDER BY source_size::DOUBLE / weight, rest, open_weight LIMIT 1
), targets AS (
  SELECT source, source_size, drift,
         CASE WHEN is_free THEN weight::DOUBLE * (SELECT rest FROM level)::DOUBLE / (2 * (SELECT open_weight FROM level))::DOUBLE
              ELSE (2 * source_size)::DOUBLE END AS target
  FROM free
), ordered AS (
  SELECT doc_id, size, source, coalesce(sum(size) OVER (
    PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized
), taken AS (
  SELECT doc_id, size, source_size::BIGINT AS source_size, target, drift, before,
         (greatest(0, least(size, round(target)::BIGINT - before)) + greatest(0, least(size, round(target)::BIGINT - before - source_size)))::BIGINT AS taken,
         CASE WHEN target > 0 THEN before / target ELSE 1.0 END AS share
  FROM ordered o JOIN targets t ON o.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN
         CASE WHEN share <= 0 THEN 0.0 WHEN drift = 0 THEN share
              ELSE 2 * share / ((1 - drift) + sqrt(greatest((1 - drift) * (1 - drift) + 4 * drift * share, 0.0))) END
       END AS position
FROM taken
"""
