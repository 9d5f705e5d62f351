"""The registered queries opN_<name>, each one operator on its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .byte_bpe import round_trip
from .chat_tree import chat_tree, read_back
from .clustering import centroid_clusters
from .common import table
from .fingerprints import fingerprints
from .line_dedup import line_dedup
from .ngram_join import near_duplicates
from .packing import packed
from .quality_rules import quality_rules
from .sharding import sharded
from .simhash_join import simhash_duplicates
from .spelling import spelling_variants
from .substring_dedup import substring_dedup
from .token_counts import token_counts

TOKEN_LIMIT = 2048


def vocabulary(name: str) -> bytes:
    return Path(public_tokenizers.path(name)).read_bytes()


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), public_tokenizers.PATTERN, TOKEN_LIMIT)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents"), min_docs=10)
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), TOKEN_LIMIT)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"), 16)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90)


def op10_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], given.schema)
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    return read_back(*chat_tree(given.unionByName(extra), ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10, length=64, scale=1024, salt="3")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), least_chars=6, least_count=5, ratio=5, drop_modulus=199)


def op13_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"), words=3, bits=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": oracles.OP2, "op7_quality_rules": oracles.OP7, "op8_substring_dedup": oracles.OP8, "op9_ngram_jaccard_join": oracles.OP9, "op10_chat_tree": oracles.OP10, "op11_centroid_clusters": oracles.OP11, "op12_spelling_variants": oracles.OP12}
