"""The registered queries of this subpackage and, where SQL can express them, their DuckDB text.

Each query reads its whole table, applies its operator with production parameters and derives the digest columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import line_dedup, lm, lz_fingerprint, mil, mixing, packing, rules, simhash, substrings, tokens, util


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    util.prepare(spark)
    return util.table(spark, sf_dir, "documents")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(documents(spark, sf_dir), min_chars=40, min_docs=5)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = rules.apply_policy(rules.measure(documents(spark, sf_dir)), "v1")
    failed = F.col("failed_bits").bitwiseAND(F.lit(rules.mask("base"))) != 0
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.packed(documents(spark, sf_dir), tokenizer(), capacity=4096)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = mil.fit(docs, util.table(spark, sf_dir, "labels").select("doc_id", "quality"))
    out = mil.scored(docs, model)
    return out.select("doc_id", mil.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.planned(documents(spark, sf_dir), weights=(5, 2, 1), max_epochs=3)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), tokenizer(), limit=2048)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(documents(spark, sf_dir))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(documents(spark, sf_dir), tokenizer())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(documents(spark, sf_dir), width=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprints(documents(spark, sf_dir))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_mix_sources": op5_mix_sources,
    "op6_token_counts": op6_token_counts,
    "op7_simhash": op7_simhash,
    "op8_lm_scores": op8_lm_scores,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_lz_fingerprints": op10_lz_fingerprints,
}

from lexloom.llm.oracles import ORACLES  # noqa: E402,F401
