"""From raw documents to packed training sequences, in five stages.

Each stage is one operator of lorestream.llm. It takes (spark, docs, sf_dir),
docs being what the stage before it kept, and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestream.llm import jaccard_join, mixing, packing, quality_rules, suffix_dedup
from lorestream.llm.common import discard, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null, empty and wordless texts do not. Repeated rows pass or go together."""
    return quality_rules.with_quality(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), that of smallest doc_id.

    Rows repeated whole leave one; texts that share a doc_id are told apart; rows
    without a doc_id stay, as do texts without words, one of each doc_id.
    """
    return jaccard_join.one_of_each_class(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each row with its own lang and source, without the passages that also start earlier in the corpus.

    A null text becomes an empty one; rows without a doc_id and rows that are equal keep everything the others do not have.
    """
    cut = suffix_dedup.remove_repeats(docs.select("doc_id", "text", "lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time it uses a document. Empty texts have no words and come along; repeated rows count each."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets; an empty text is one piece, the closing id; each row is packed."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_good),
    ("jaccard_join", keep_one_of_each_class),
    ("suffix_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Compression, hypergeometric draws and tokenizers are beyond SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one stage returns is a table in the shared folder that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
