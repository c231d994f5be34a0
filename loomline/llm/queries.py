"""Registered queries of the subpackage: one per operator, over whole tables, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import byte_bpe, conversation_trie, decontaminate, html_extract, license_scan, ngram_jaccard, periodic_runs, quality_rules, simhash_dedup, suffix_dedup, token_records, url_filter, warc


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the installed public tokenizers, or of the folder that LOOMLINE_TOKENIZERS names."""
    folder = os.environ.get("LOOMLINE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, url_filter.RULES))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.token_records(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.known(spark))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), bpe_pattern())


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(conversation_trie.rebuilt(conversation_trie.sequences(table(spark, sf_dir, "conversations"))))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.report(simhash_dedup.near_duplicates(table(spark, sf_dir, "documents")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(periodic_runs.periodic_runs(periodic_runs.with_repeats(table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_url_filter, op3_token_records, op4_quality_rules, op5_warc, op6_html_extract, op7_license_scan, op8_ngram_jaccard, op9_decontaminate, op10_byte_bpe, op11_conversation_trie, op12_simhash_dedup, op13_periodic_runs)}

ORACLES = {"op2_url_filter": url_filter.ORACLE, "op4_quality_rules": quality_rules.ORACLE, "op5_warc": warc.ORACLE, "op7_license_scan": license_scan.oracle(), "op8_ngram_jaccard": ngram_jaccard.ORACLE, "op11_conversation_trie": conversation_trie.ORACLE}
