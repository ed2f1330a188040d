"""The pipeline over documents: each stage is an operator, written as Parquet and read as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import bloom_dedup, lexical_packing, simhash_links, suffix_dedup, toxicity_pu
from foliant.llm.common import Scratch
from foliant.llm.queries import table, tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic. Null and empty texts have the score of the bias alone and stay, as do
    repeated rows and rows without an id; an empty table stays empty."""
    return toxicity_pu.toxicity(spark, docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space apart: the one with the smallest id. Null and empty texts
    are one group; of rows that repeat that id one stays; an empty table stays empty."""
    return bloom_dedup.exact_dedup(spark, docs).where("kept").select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8): the one with the smallest id. Rows without an
    id stay; texts without words are one group; an empty table stays empty."""
    return simhash_links.near_dedup(spark, docs).select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes and more that also start elsewhere. Every row stays, if only with what
    is left; null texts stay null; an empty table stays empty."""
    return suffix_dedup.without_repeats(spark, docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences. A null or empty text is its end id alone; repeated rows are packed each; an
    empty table gives no piece."""
    return lexical_packing.pack(spark, docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("packing", packing),
]

#: SQL can't express the classifiers and the packing.
ORACLE_SQL = None


# Every stage reads the five columns of documents, whatever else is there, and texts of any length whole.


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage{k}")
            if k:
                scratch.drop(f"stage{k - 1}")
    return docs
