"""Filter interaction audit: what each of several filters removes in every order of application.

Whether a document is removed at a step depends only on the set of filters applied
before and on the filter of that step. These pairs are the edges of the lattice of
filter subsets: 80 for five filters. Documents are first counted by part and by the set
of filters that they fail, at most 32 sets; each count contributes to the edges, the
edges are summed, and every order of the filters, a path of five edges from the empty set
to the full one, takes its steps' figures from them: 600 steps for 120 orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import spool

#: What parts the words of a text.
_GAPS = r"[\x20\x09-\x0D]+"

LEAST_WORDS = 200
#: In per cent: distinct words of all words at least, capitals of all characters at most.
LEAST_DISTINCT, MOST_CAPITALS = 50, 2
SYMBOLS = r"[#$%&*|]"

#: The letter of the filter that looks for an equal text with a smaller id.
COPY = "E"


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions by letter that need nothing but the text, which isn't null, and its words."""
    n = F.size(words)
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def failures(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
    good_col: str = "quality", toxic_col: str = "toxic",
) -> tuple[DataFrame, str]:
    """``(part, mask, n, good, toxic)``, documents by part and failed filters, and the filters' letters.

    Bit i of ``mask`` is set if the document fails the filter of letter i. A null text is
    empty and a null part the empty string; a row without an id is no one's copy and no
    one's original; rows that repeat an id and text are each counted, and none is the
    other's copy. An id counts as labelled 1 if any of its label rows says so.
    """
    texts = docs.select(
        docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.coalesce(docs[f"`{part_col}`"].cast("string"), F.lit("")).alias("part"),
        F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"),
    ).withColumn("words", F.array_remove(F.split("text", _GAPS), ""))
    found = text_filters(F.col("text"), F.col("words"))
    letters = "".join([*found, COPY])
    bits = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(found.values())), F.lit(0))
    # Texts are read once; all that follows works on these few bytes a document.
    marks = spool(texts.select("doc_id", "part", bits.cast("int").alias("bits"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), "marks")
    first = marks.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = labels.select(*(labels[f"`{c}`"].alias(n) for c, n in ((id_col, "doc_id"), (good_col, "good"), (toxic_col, "toxic"))))
    marked = marked.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *(F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c) for c in ("good", "toxic"))
    )
    # Equal texts are joined by text and id: a group of copies spreads by its ids, and equal rows are one row by now.
    rows = marks.groupBy("doc_id", "digest", "part", "bits").agg(F.count("*").alias("n"))
    rows = rows.join(first, ["digest", "doc_id"], "left").join(marked, "doc_id", "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << len(found)).otherwise(0)
    counts = rows.groupBy("part", F.col("bits").bitwiseOR(copy).alias("mask")).agg(
        F.sum("n").alias("n"), *(F.sum(F.coalesce(F.col(c), F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic"))
    )
    return counts, letters


def edges(counts: DataFrame, letters: str) -> DataFrame:
    """Figures of every edge ``(part, before, filter)``: ``before`` is the set of filters applied, as bits."""
    size = len(letters)
    pairs = [(before, i) for i in range(size) for before in range(1 << size) if not before >> i & 1]
    # A weight is the number of orders that pass the edge.
    weights = [factorial(before.bit_count()) * factorial(size - 1 - before.bit_count()) for before, _ in pairs]
    edge = F.explode(F.array(*(F.struct(F.lit(b).alias("before"), F.lit(i).alias("filter"), F.lit(1 << i).alias("bit"), F.lit(w).alias("orders")) for (b, i), w in zip(pairs, weights, strict=True))))
    reached = F.col("mask").bitwiseAND(F.col("before")) == 0
    bit = F.col("bit")
    fails = F.col("mask").bitwiseAND(bit) != 0
    removed = reached & fails

    def total(condition: Column, of: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0)).cast("long")

    return (
        counts.select("*", edge.alias("edge")).select("part", "mask", "n", "good", "toxic", "edge.*")
        .groupBy("part", "before", "filter", "orders").agg(
            total(reached & ~fails).alias("kept"), total(removed).alias("removed"), total(fails & ~reached).alias("redundant"),
            total(F.col("mask") == bit).alias("unique_fails"), total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"),
        )
    )


def paths(edges: DataFrame, letters: str) -> DataFrame:
    """``(part, filter_order, step, ...)``: the steps of every order of the filters with the figures of their edges."""
    steps = [
        ("".join(letters[i] for i in order), step + 1, sum(1 << i for i in order[:step]), order[step])
        for order in permutations(range(len(letters))) for step in range(len(letters))
    ]
    lattice = edges.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, filter int")
    # Over all orders a filter removes what its edges remove, each as often as orders pass it.
    valued = edges.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "filter")).cast("long"))
    return valued.join(F.broadcast(lattice), ["before", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, zeros included.

    As in ``failures``: null texts are empty, null parts the empty string, very long texts
    count whole, equal rows each count; other columns are ignored; without documents there
    are no parts and no rows, without labels nothing good or toxic is lost.
    """
    counts, letters = failures(docs, labels)
    return paths(edges(counts, letters), letters)


ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first FROM texts GROUP BY text
), marked AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), docs AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(t.doc_id > first, false)::INT AS mask
  FROM texts t JOIN firsts USING (text) LEFT JOIN marked USING (doc_id)
), counts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT [a.letter, b.letter, c.letter, d.letter, e.letter] AS letters, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT array_to_string(letters, '') AS filter_order, step, bits[step] AS bit, list_sum(bits[1:step]) - bits[step] AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), figures AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & before = 0 AND mask & bit = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts CROSS JOIN (SELECT filter_order, step, bit::INT AS bit, before::INT AS before FROM steps) GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM figures
"""
