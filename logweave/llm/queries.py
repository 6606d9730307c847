"""One registered query per operator, over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import (ball_codes, chat_format, decontamination, importance_sampling, language_ppm, line_dedup, mixing, quality_fm,
                          quality_rules, simhash_dedup, token_counts, topk_search, url_filters)
from logweave.llm.common import crc_slice, table


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_fm.fit(docs, table(spark, sf_dir, "labels"), ~crc_slice(F.col("doc_id"), 5, 0))
    scored = quality_fm.score(docs, model)
    return scored.select("doc_id", crc_slice(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op4_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_ppm.fit(docs, ~crc_slice(F.col("doc_id"), 4, 2))
    found = language_ppm.identify(docs, model)
    return found.select("doc_id", crc_slice(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(own)
    return chat_format.digests(chat_format.format_chats(rows))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), k=20, scale=64.0, every=20)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines")


#: Shares of the expected tokens that the mix is to have.
MIX = {"good": .88, "poor": .07, "toxic": .05}


VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

#: The rules of op7: places, then patterns for hosts that sell by their name.
URL_RULES = [
    url_filters.Place("org", "/", "allow"), url_filters.Place("example.org", "/es/", "block"),
    url_filters.Place("example.org", "/en/1", "block"), url_filters.Place("com", "/fr/", "allow"),
    url_filters.Place("com", "/de/", "block"),
    *[url_filters.Pattern(p) for p in ("||casino-*.", "||*-casino.", "||free-*.", "||*-bets.", "||*-pills.", "||cheap-*.", "||adult-*.",
                                       "||*-porn.", "||buy-*.")],
]


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.read_vocabulary(VOCABULARY))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), labels, MIX).drop("text_hash")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "windows", "share")


def op11_importance_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_sampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20,
                                         longest=1, buckets=10000, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_codes.digests(*ball_codes.compress(table(spark, sf_dir, "embeddings"), parts=16, size=64, rounds=2, scale=256.0))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "lang", quality_rules.RULES,
                                 risk=.02, error=.05)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_fm, op2_token_counts, op3_mixing, op4_language_ppm, op5_chat_format, op6_simhash_dedup,
    op7_url_filters, op8_decontamination, op9_topk_search, op10_line_dedup, op11_importance_sampling, op12_ball_codes, op13_quality_rules)}
