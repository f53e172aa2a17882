"""From raw documents to packed training sequences: the stages, in order, and all of them at once.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents, others that ``docs`` has
included, whatever their names. An empty table gives an empty one. Rows that share
a doc_id are judged one by one up to near_dedup, which leaves one of them; rows
without doc_id are never anyone's duplicate. Texts are worked on whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from volumetra.llm import near_dedup, packing, quality_rules, secrets, toxicity
from volumetra.llm.common import saved, scratch, table
from volumetra.llm.queries import _vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, predicts toxic go. Null and empty texts are clean."""
    return toxicity.without_toxic(docs, docs, table(spark, sf_dir, "labels"))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go; documents that fail, or lose too much, go, and with them null and empty texts."""
    return quality_rules.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (sets of 5-word shingles, similarity 0.8 or more): that of the
    smallest doc_id. Texts without words are in no group."""
    return near_dedup.keep_one(docs, 5)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask, those that overlap by one. No document goes; null texts stay null."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets. A null or empty text is one piece, of the end alone."""
    return packing.packed(packing.pieces(docs, _vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: Trained, iterative and tokenizing stages cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; what they wrote goes at the end, but for the result."""
    with scratch():
        docs = table(spark, sf_dir, "documents")
        for _, stage in STAGES[:-1]:
            docs = saved(stage(spark, docs, sf_dir))
        return saved(STAGES[-1][1](spark, docs, sf_dir), keep=True)
