"""The dealt operators over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pageframe.llm import (
    alignment,
    chat_format,
    embedding_dedup,
    exact_dedup,
    lexical_search,
    license_scan,
    line_dedup,
    mixing,
    packing,
    quality,
    simhash_dedup,
    substring_dedup,
    token_counts,
)
from pageframe.llm.texts import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_classifier(spark, sf_dir):
    stats = stored(quality.with_statistics(table(spark, sf_dir, "documents")), "quality-statistics")
    model = quality.fit(quality.labelled(stats, table(spark, sf_dir, "labels")))
    return quality.quality_scores(stats, model)


@query
def op2_substring_dedup(spark, sf_dir):
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op3_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


@query
def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


@query
def op5_embedding_dedup(spark, sf_dir):
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


@query
def op6_chat_formatting(spark, sf_dir):
    return chat_format.chat_format(table(spark, sf_dir, "conversations"))


@query
def op7_simhash_dedup(spark, sf_dir):
    return simhash_dedup.simhash_dedup(table(spark, sf_dir, "documents"))


@query
def op8_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op9_packing(spark, sf_dir):
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer, with_ids=False)


@query
def op10_license_scan(spark, sf_dir):
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


@query
def op11_lexical_search(spark, sf_dir):
    return lexical_search.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_token_counts(spark, sf_dir):
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer)


@query
def op13_token_alignment(spark, sf_dir):
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_tokens(table(spark, sf_dir, "documents"), a, b)
