"""From documents to packed training sequences: the corpus operators as one pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the
shared checkpoint folder and reads it back as the next stage's docs. All stages but the last return the
columns of documents. No stage cuts or samples its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilegraph.llm import bagminhash, decontam, line_dedup, packing, toxicity
from tilegraph.llm.common import discard, materialise, table
from tilegraph.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    return toxicity.stage(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each site go; every document stays."""
    return line_dedup.stage(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return bagminhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.stage(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 2048 tokens."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learned scores, signatures and token ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        discard(before)  # the next stage's table holds all that is kept
    return docs
