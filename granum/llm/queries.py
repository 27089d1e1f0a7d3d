"""The numbered queries of this subpackage and their SQL: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granum.llm import sql
from granum.llm.common import read
from granum.llm.minhash_dedup import near_duplicates
from granum.llm.piece_codec import encode
from granum.llm.pivot_dedup import near_vectors
from granum.llm.quality_rules import judge_quality
from granum.llm.shuffle_shards import shard_rows
from granum.llm.site_quality import judge_sites
from granum.llm.soft_mixing import mix_softly
from granum.llm.token_counts import token_counts
from granum.llm.url_filter import judge_urls
from granum.llm.wrapper_induction import main_text


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op2_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_sites(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), carry=["doc_id"])


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "verdict string, rule string"))


def op5_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept")


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_softly(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), carry=["doc_id"])


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=2)


def op9_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("piece_bpe_32k.model")
    coded = encode(read(spark, sf_dir, "documents"), path, decoded="decoded")
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "n_byte_pieces", F.length("decoded").cast("long").alias("decoded_chars"), F.crc32("decoded").alias("decoded_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pivot_dedup": op1_pivot_dedup,
    "op2_site_quality": op2_site_quality,
    "op3_token_counts": op3_token_counts,
    "op4_url_filter": op4_url_filter,
    "op5_shuffle_shards": op5_shuffle_shards,
    "op6_quality_rules": op6_quality_rules,
    "op7_soft_mixing": op7_soft_mixing,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_wrapper_induction": op9_wrapper_induction,
    "op10_piece_codec": op10_piece_codec,
}

ORACLE_SQL: dict[str, str] = {"op1_pivot_dedup": sql.NEAR_VECTORS, "op4_url_filter": sql.URL_FILTER, "op6_quality_rules": sql.QUALITY_RULES, "op8_minhash_dedup": sql.NEAR_DUPLICATES}
