"""A training corpus in five stages, each applied to all that its predecessor kept.

Documents below the quality threshold go; one document of each near-duplicate
component stays; documents contaminated by the benchmark go; personal data is
replaced by its kind; what is left is packed into token sequences.

Every stage takes any rows of ``documents``: null and empty texts, null ids,
ties, repeated rows, very long texts, empty tables and further columns (which
all but the last return untouched). Each docstring says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, packing, pii, quality, simhash
from tidemark.llm.common import table
from tidemark.session import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored as one empty passage; equal texts and repeated
    rows are decided alike; long texts are read in slices; without both labels
    every document is kept; labels of ids that occur nowhere, and null ones, don't count.
    """
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: a row with its smallest id.

    Null and empty texts share the fingerprint zero, so one of them stays; of
    repeated rows one stays; an id with several texts keeps a row of each
    component it names; a component without ids keeps one row; ties go to the
    least text.
    """
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, by the contract's contamination rule.

    Null and empty texts have no words and stay; repeated rows go or stay
    together; null items and an empty benchmark hit nothing; long texts are
    scanned whole.
    """
    return decontam.clean_of(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars following.

    Null texts stay null and empty ones empty; of overlapping spans the first
    names the replacement; repeated rows are changed alike; long texts take work
    in proportion.
    """
    return pii.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences, one row each.

    Null and empty texts are the end id alone; repeated rows are packed each for
    itself and spread over blocks; long texts are cut into full sequences.
    """
    return packing.packed(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained stages nor the packing; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
