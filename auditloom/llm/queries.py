"""The queries op1 to op13 and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import bpe, chat, crf_quality, exact_dedup, fill_middle, line_dedup, mixing, near_dedup, ngram_lm, sharding, spelling, substring_dedup, weak_rules
from auditloom.llm.common import table


def op1_shard_by_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_equal_texts(table(spark, sf_dir, "documents"), shards=8)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_chats(turns.unionByName(chat.hard_case(spark))))


def op3_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf_quality.score(docs, crf_quality.train(docs, table(spark, sf_dir, "labels")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_weak_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256")
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256")
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(table(spark, sf_dir, "documents")))


def op12_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_shard_by_label_propagation, op2_chat_format, op3_crf_quality, op4_exact_dedup, op5_mix_sources,
        op6_minhash_near_dedup, op7_weak_quality_rules, op8_substring_dedup, op9_byte_bpe, op10_line_dedup,
        op11_spelling_variants, op12_interpolated_lm, op13_fill_in_middle,
    )
}

ORACLES = {
    "op2_chat_format": chat.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op13_fill_in_middle": fill_middle.ORACLE,
}
