"""The registered queries of this subpackage and their SQL. Each reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bloom_dedup, lattice_links, lexical_packing, piece_codec, pitman_yor, prefix_trie, reply_trees, simhash_links, suffix_dedup, toxicity_pu, turn_repair, url_reputation, warc_zstd


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.url_verdicts(spark, table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.piece_codec(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_links.simhash_components(spark, table(spark, sf_dir, "documents"))


def op4_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_packing.pack(spark, table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_pu.toxicity(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_texts(spark, table(spark, sf_dir, "documents"))


def op7_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_dedup.exact_dedup(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_lattice_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_links.lattice_links(spark, table(spark, sf_dir, "embeddings"))


def op10_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.warc_round_trip(spark, table(spark, sf_dir, "pages"))


def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_trees.conversation_digests(spark, table(spark, sf_dir, "conversations"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.damage_and_repair(spark, table(spark, sf_dir, "conversations"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark, table(spark, sf_dir, "conversations"), rebuild=True)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_reputation, op2_piece_codec, op3_simhash_links, op4_lexical_packing, op5_toxicity_pu, op6_pitman_yor, op7_bloom_dedup, op8_suffix_dedup, op9_lattice_links, op10_warc_zstd,
        op11_reply_trees, op12_turn_repair, op13_prefix_trie,
    )
}

ORACLE_SQL = {
    "op1_url_reputation": url_reputation.oracle(),
    "op7_bloom_dedup": bloom_dedup.ORACLE,
    "op8_suffix_dedup": suffix_dedup.ORACLE,
    "op9_lattice_links": lattice_links.ORACLE,
    "op10_warc_zstd": warc_zstd.ORACLE,
    "op11_reply_trees": reply_trees.ORACLE,
    "op12_turn_repair": turn_repair.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
