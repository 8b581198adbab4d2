"""The thin query of each operator, on the given tables, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm import (
    divergence, filter_audit, fingerprints, language, licences, lines, mixing, packing, quality_votes, rules, substrings, token_files,
)
from gramloom.llm.common import documents, new_path
from gramloom.llm.jaccard import jaccard_components


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    pairs = fingerprints.edited_pairs(documents(spark, sf))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.hexed(F.col("sketch")).alias("fingerprint"), fingerprints.hexed(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        "next_id",
    )


def op2_language(spark: SparkSession, sf: str) -> DataFrame:
    model = language.text_model(documents(spark, sf))
    return language.identify(language.from_pages(documents(spark, sf, "pages")), model).withColumnRenamed("id", "page_id")


def op3_licences(spark: SparkSession, sf: str) -> DataFrame:
    return licences.scan(licences.as_files(documents(spark, sf)))


def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(documents(spark, sf)).select("doc_id", "size", "source_size", "target", "taken")


def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(documents(spark, sf), public_tokenizer())


def op6_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.dedup_substrings(documents(spark, sf)).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf)).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op8_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_components(documents(spark, sf))


def op9_quality_votes(spark: SparkSession, sf: str) -> DataFrame:
    return quality_votes.classify(documents(spark, sf), documents(spark, sf, "labels"))


def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.judge(documents(spark, sf)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark)
    token_files.write_tokens(documents(spark, sf), public_tokenizer(), path)
    return token_files.read_documents(spark, path)


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit_documents(documents(spark, sf), documents(spark, sf, "labels"))


def op13_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit_sources(documents(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_language": op2_language,
    "op3_licences": op3_licences,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_substrings": op6_substrings,
    "op7_line_dedup": op7_line_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality_votes": op9_quality_votes,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_files": op11_token_files,
    "op12_filter_audit": op12_filter_audit,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op4_mixing": mixing.SQL,
    "op7_line_dedup": lines.SQL,
    "op10_quality_rules": rules.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_source_divergence": divergence.SQL,
}
