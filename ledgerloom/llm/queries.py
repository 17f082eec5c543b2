"""The registered queries of the operators: production parameters, whole tables, whole texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import ann, bpe, chat, digest_index, filter_audit, licenses, mixing, ngram_join, oracles, pii, ppm, prefix_trie, quality, sharding
from ledgerloom.llm.common import load, shared_dir


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(load(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    return out.select("doc_id", F.col("_ld_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.features(load(spark, sf_dir, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(*base, (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(load(spark, sf_dir, "documents"), span=4, percent=85)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(load(spark, sf_dir, "conversations"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "weight", "probability", "kept")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(load(spark, sf_dir, "documents"), tokenizer_path())


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(load(spark, sf_dir, "documents"))
    return out.withColumn("blocks", F.array_join(F.transform("blocks", lambda b: F.concat_ws(":", b["line"], b["label"])), ","))


def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(load(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(load(spark, sf_dir, "documents"), count_col="n_entities")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return ann.search(ann.build(vectors), vectors.where("vec_id % 50 = 0"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations")
    return prefix_trie.trie(prefix_trie.regrafted(prefix_trie.sequences(turns), group=5, heads=9))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = digest_index.DigestIndex(spark, f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}")
    return digest_index.report(load(spark, sf_dir, "documents"), index)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_quality": op2_quality,
        "op3_ngram_join": op3_ngram_join,
        "op4_chat": op4_chat,
        "op5_bpe": op5_bpe,
        "op6_mixing": op6_mixing,
        "op7_licenses": op7_licenses,
        "op8_ppm": op8_ppm,
        "op9_pii": op9_pii,
        "op10_nearest": op10_nearest,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_filter_audit": op12_filter_audit,
        "op13_exact_dedup": op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
