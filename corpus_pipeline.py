"""The corpus pipeline: quality rules, near-duplicates, repeated spans, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``; a stage works on all that its predecessor kept. Null
ids, null and empty texts, ties, repeated rows, empty tables and extra columns
follow the operators' own rules: see quality_rules.keep_clean,
ngram_jaccard.keep_one, suffix_dedup.without_repeats,
decontaminate.without_benchmark and byte_bpe.round_trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import byte_bpe, decontaminate, ngram_jaccard, quality_rules, suffix_dedup
from loomline.llm.queries import bpe_pattern, table, tokenizer_file
from loomline.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    return ngram_jaccard.keep_one(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that occur twice are cut from the texts."""
    return suffix_dedup.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text left, checked by decoding: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return byte_bpe.round_trip(docs, tokenizer_file("byte_bpe_50k.tiktoken"), bpe_pattern())


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("suffix_dedup", repeated_spans),
    ("decontaminate", benchmark_leaks),
    ("byte_bpe", tokens),
]

#: SQL can express neither the byte spans nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a written table of the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
