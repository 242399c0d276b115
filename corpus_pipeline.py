"""The cleaning pipeline over ``documents``: each stage takes what its
predecessor kept, and all but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import bpe, decontaminate, near_copies, quality_rules, toxicity
from gristmill.llm.common import discard, landed, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and short texts go, as do very repetitive ones; repeated rows
    are judged alike. All stages keep extra columns and give an empty table for one."""
    return quality_rules.keep_good(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The labels that the model learns from are those of the documents that are
    left. Null and empty texts stay, as texts without a term."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies. SimHash's links, as in ``op1``: fingerprints met by
    anchor-point covering and compared whole, three bits or less; and those it misses by design, between
    texts whose five-word shingles have a similarity of 0.8. Classes are closed over both.
    Texts without a word are copies of each other; of repeated rows one stays."""
    return near_copies.one_of_each(docs, fingerprints=True)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts stay, as texts that nothing hits; repeated rows stay rows."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a row; null and empty texts have no tokens."""
    return bpe.digests(docs, bpe.load())


STAGES = [("quality_rules", quality), ("toxicity", clean), ("simhash_near_dedup", distinct), ("decontamination", unseen), ("bpe", tokens)]

#: The fitted, iterative and tokenizing stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again;
    what a stage has read is removed once its result is written."""
    docs, first = table(spark, sf_dir, "documents"), True
    for name, stage in STAGES[:-1]:
        now = landed(stage(spark, docs, sf_dir), name)
        if not first:
            discard(docs)
        docs, first = now, False
    return STAGES[-1][1](spark, docs, sf_dir)
