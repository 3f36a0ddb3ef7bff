"""Registered queries of the subpackage: ``opN_<name>`` applies operator N to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpulse.llm import (
    alignment, chat, decontaminate, embeddings, frames, jaccard, licenses, lines, mixing, oracle_sql, passages, quality,
    sharding, whitening,
)
from orgpulse.llm.scratch import Scratch
from orgpulse.llm.vocab import vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of ``benchmark`` of which a document contains 0.8 or more of the 5-word shingles."""
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at Jaccard 0.9 on 3-word shingles over all ``documents``."""
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"), n=3, num=90, den=100).select(
        "doc_id", "n_shingles", "component_id", "set_id")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -7, formatted and read back."""
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], given.schema)
    return chat.digests(chat.format_chats(chat.from_turns(given.union(added)))).withColumnRenamed("tree", "conv_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all ``documents``, by Dice 0.8 over word bigrams."""
    return licenses.license_matches(_table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 6))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all ``documents``: sources weigh 5, 2, 1 in turn and share 150 % of all words."""
    return mixing.mix_plan(_table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.9 over all ``embeddings``."""
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text of ``documents``, learnt from ``labels.quality``."""
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without globally repeated multi-line chunks of eight chunkings, as digests of what remains."""
    return lines.dedup_lines(_table(spark, sf_dir, "documents"), chunkings=8).select(
        "doc_id", "n_lines", "removed_lines", "removed_chunks",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 7 of a tree of regions and racks, by doc_id."""
    return sharding.shard_plan(_table(spark, sf_dir, "documents"))


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the bytes of 100-byte strings that also start earlier."""
    return passages.remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str, a: str = "byte_bpe_50k.json",
                             b: str = "piece_bpe_32k.model") -> DataFrame:
    """Byte-level and piece tokens of all ``documents`` aligned; each distinct text once."""
    docs = _table(spark, sf_dir, "documents")
    return alignment.aligned_documents(docs, alignment.align(docs, vocabulary(a), vocabulary(b)))


def op12_token_frames(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """All ``documents`` encoded, written as files of zstandard frames, and read back from them."""
    path = f"{Scratch(spark, 'frames').root}/tokens"
    frames.write_token_files(_table(spark, sf_dir, "documents"), path, vocabulary(tokenizer))
    return frames.read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` on the first eight components, whitened."""
    vectors = _table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit_whitening(vectors)).withColumn("deviation", F.col("deviation").cast("long"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_benchmark_decontamination,
        op2_ngram_jaccard_join,
        op3_chat_formatting,
        op4_license_scan,
        op5_mixing,
        op6_embedding_near_dedup,
        op7_quality_classifier,
        op8_line_dedup,
        op9_sharding,
        op10_passage_dedup,
        op11_tokenizer_alignment,
        op12_token_frames,
        op13_embedding_whitening,
    )}


def all_oracles() -> dict[str, str]:
    return dict(oracle_sql.ORACLES)
