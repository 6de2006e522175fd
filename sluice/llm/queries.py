"""The corpus queries: name to (spark, sf_dir) -> DataFrame, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact, langid, lines, manifest, mixing, neardup, phrases, pieces, pii, quality, tokens
from .common import lower_ascii, read_table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.copies(mixing.sized(read_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(read_table(spark, sf_dir, "documents"), width=4)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.without_lines(read_table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        F.col("__sl_lines").alias("lines_removed"),
        F.col("__sl_words").alias("words_removed"),
        F.length("__sl_text").cast("long").alias("chars_left"),
        F.sha2("__sl_text", 256).alias("text_sha256"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", "lines_removed")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :t), (-7L, 1L, 'assistant', :t) AS x(conv_id, turn, role, text)", args={"t": tricky})
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_surrogates(read_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read_table(spark, sf_dir, "documents"))


def op11_phrase_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {c: F.col(c) for c in manifest.COLUMNS}
    tampered = manifest.leaf_digest(*(columns | {"text": lower_ascii(F.col("text"))}).values())
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = manifest.manifest(read_table(spark, sf_dir, "documents"), candidate=F.when(chosen, tampered))
    shown = rows.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest().alias("proof_sha256"), manifest.folded(F.coalesce("candidate", "leaf")).alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        "n_words",
        decontam.words_hit(F.col("spans")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("spans").isNotNull().alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mixing, op2_minhash_neardup, op3_token_counts, op4_exact_dedup, op5_line_dedup, op6_quality_rules, op7_chat_formatting, op8_language_id, op9_pii_surrogates, op10_sentencepiece, op11_phrase_collocation, op12_merkle_manifest, op13_decontamination)}
