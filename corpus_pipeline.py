"""The corpus pipeline: each stage takes what the one before kept.

The last stage returns the mix: one row for each document left, with the copies that it gets.  ORACLE_SQL is None: learned toxicity
scores, fingerprints and tiles are beyond SQL; tests compare the stages with brute force.

All stages keep rows with null or empty texts (unless they are copies of each other) and null doc_ids, treat repeated rows alike, take
texts of any length, keep further columns, and return no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phrasemine.functions.scratch import forget, settled
from phrasemine.llm import decontaminate, exact_dedup, mixing, simhash, toxicity
from phrasemine.llm.common import table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labels scores below one half; without labels of both classes the share of toxic ones decides."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the row with the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints the document with the smallest doc_id; texts without words are linked to each other."""
    return simhash.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document towards its source's target, zero included; a null source is a source."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder, read by the next and then deleted with its intermediate tables."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = settled(spark, lambda: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
