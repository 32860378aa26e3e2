"""A training corpus from raw documents: five stages, each one of the operators in ``vouchwell.llm``.

Each stage gets the table that the one before has written; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vouchwell.llm import language, mixing, near_copies, queries, substrings
from vouchwell.llm._shared import discard, settled, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go.

    Null, empty and letterless texts go; a null source or language only leaves its evidence out;
    repeated rows are judged alike and stay or go together; no rows give none.
    """
    return language.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, likeness 0.8 or more.

    It is the one with the least id; ids that are null come after all others, ties go by the text.
    Repeated rows are copies of each other, null and empty texts too; no rows give none.
    """
    return near_copies.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that start twice in the remaining corpus are cut from the texts.

    Documents of which nothing is left go; null and empty texts stay, as empty ones; repeated rows
    are copies of each other and go if they are long enough; no rows give none.
    """
    return substrings.remove_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out to meet their sources' targets.

    Texts without words are never taken; a null source is a source; repeated rows and rows with
    equal or null ids are drawn one by one; no rows give none.
    """
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences.

    A null or empty text is its end id alone; repeated rows are packed each; no rows give none.
    """
    return queries.packed_pieces(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mixing", source_mix),
    ("packing", pack),
]

#: Byte-level tokenisation, hashes and trigram models have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table goes when the next one is written; the last
    one's input stays until the session ends, since its pieces are read from it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = settled(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
