"""The corpus pipeline: from documents to packed sequences, one operator a stage.

Each stage takes all rows that the one before it kept. All but the last return the columns of documents.

Null and empty texts are clean, are copies of each other, hold no passage, and pack as one id. Of equal documents, and of
those that tie, the smallest doc_id stays, null ids last. An empty table passes through every stage; other columns of
documents pass through all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, packing, simhash, suffix, toxicity
from quern.llm.shared import remove, store, table


def _reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net).where("predicted = 0").select(*docs.columns)


def _drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that share 0.8 of their five-word shingles, the one with the smallest doc_id."""
    return simhash.keep_first(docs).select(*docs.columns)


def _cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes that occur more than once; n_chars follows."""
    return suffix.dedup_substrings(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def _drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(*docs.columns)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", _reject_toxic),
    ("simhash near-dedup", _drop_near_duplicates),
    ("suffix-array dedup", _cut_repeated_passages),
    ("benchmark decontamination", _drop_contaminated),
    ("packing", _pack),
]

#: SQL can express neither the network nor the tokenizer; tests hold the stages against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet and read again; a stage's rows go once the next has read them."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, at = store(stage(spark, docs, sf_dir))
        if before is not None:
            remove(spark, before)
        before = at
    return docs
