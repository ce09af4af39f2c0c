"""The corpus pipeline: five stages from raw documents to a training order.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of ``documents``; the last returns the training order. Every row follows its own
text, with or without an id; texts are read whole; columns of any other name go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import mixing, pii
from loam.llm.decontam import drop_contaminated
from loam.llm.neardup import drop_near_duplicates
from loam.llm.quality import drop_low_quality
from loam.llm.shared import drop_spooled, scratch, spool, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the classifier rejects.

    A null or empty text has no evidence of its own and follows its site; a null source or
    language is a site of its own; rows that repeat all go or all stay.
    """
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the smallest id.

    Texts without words are no one's copies, but of such rows that share an id one stays;
    rows without an id stay; of rows that repeat an id and text one stays.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows in whose text an item of ``benchmark`` occurs within its edits; null and empty texts stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; ``n_chars`` follows the new text; null texts stay null."""
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else redacted


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order of the rows that the mix takes, each as often as it takes them.

    Documents without words are never taken; a null source is a source of its own;
    columns named as those of the order are replaced.
    """
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii_redaction),
    ("mixing", mix_sources),
]

#: Trained classifiers, edit distances and redaction have no SQL form; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(spool(stage(spark, docs, sf_dir), name))
        if before is not None:
            drop_spooled(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
