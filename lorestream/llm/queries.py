"""The registered queries of this subpackage, one opN_<name> for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestream.llm import embedding_dedup, factorization, jaccard_join, license_scan, merkle, mixing, packing, quality_rules, sentencepieces, suffix_dedup, token_counts, toxicity, word_runs


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes removed because a 100-byte string over them also starts earlier."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept_text")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: counts of the base rules, compression ratios and the verdict."""
    return quality_rules.with_quality(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its source's target and the words the mix takes of it, with the shards they go to."""
    out = mixing.plan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.col("copies.shard").alias("shards"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per token piece: its checksum, sequence and offset."""
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: links at cosine 0.98 or more within its label, and its component."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: quality score of a factorisation machine that learned from two of three label folds."""
    return factorization.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: toxicity score of a linear model that learned from four of five label folds."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens of the best unigram segmentation over the pieces of a public vocabulary."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: digest of its canonical text, the licence it is, and licence notices among its lines."""
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its component under Jaccard 0.85 or more on four-word shingles."""
    return jaccard_join.join_classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "set_id", "component_id")


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: periodic runs of its words, the longest one, digests of all and of the text they collapse to."""
    return word_runs.summary(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: leaf, source's root, root, digest of its proof, and the root a tampered copy leads to."""
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of token ids, and digests of the ids and of the text they decode to."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_source_mixing": op3_source_mixing,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_license_scan": op9_license_scan,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_word_runs": op11_word_runs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_sentencepiece": op13_sentencepiece,
}

ORACLE_SQL: dict[str, str] = {"op9_license_scan": license_scan.oracle_sql()}
