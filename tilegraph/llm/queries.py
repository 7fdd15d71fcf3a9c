"""The registered query of each corpus operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, decontam, embed_dedup, fingerprints, importance, licenses, line_dedup, packing, pii, prefix_trie, rindex, token_counts, toxicity
from .common import table

#: The vocabulary of packing and token counts; any path of the tokenizers library serves.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the boilerplate lines of its site."""
    return line_dedup.query(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of each document once all repeats of 200 bytes or more are removed."""
    return rindex.remove_repeats(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document, learned from labels that are not held out."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each vector at a cosine of 0.98."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document, by patterns and by bootstrapped contexts."""
    return pii.extract(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of each document, by weighted Jaccard similarity of its shingles."""
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of each document before and after three edits."""
    return token_counts.counts_after_edits(table(spark, sf_dir, "documents"), token_counts.trial_edits(), TOKENIZER)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License that each document is, and licenses that its notices name."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of each document that holds a benchmark item; shares rounded to six places."""
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *(F.round(c, 6).alias(c) for c in ("lcs", "answer", "cosine")))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each document and of its edited text, their likeness, and its near-duplicate class."""
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of each document, drawn towards the benchmark's distribution."""
    return importance.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_line_dedup, op2_suffix_array_dedup, op3_toxicity, op4_embedding_near_dedup, op5_packing, op6_pii, op7_minhash_near_dedup, op8_token_counts, op9_license_scan, op10_benchmark_decontamination,
        op11_conversation_prefix_trie, op12_document_fingerprints, op13_importance_resampling,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE_SQL, "op9_license_scan": licenses.ORACLE_SQL,
        "op11_conversation_prefix_trie": prefix_trie.ORACLE_SQL, "op13_importance_resampling": importance.ORACLE_SQL,
    }
