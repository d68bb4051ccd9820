"""The training-data pipeline: quality, exact dedup, near dedup, mix, packing, each over all that the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe.llm import exact_dedup, mixing, packing, quality, simhash_dedup
from pageframe.llm.texts import folded, stored, whole_row

TOKENIZER = "word_bpe_49k.json"
QUALITY_THRESHOLD = 0.7


def _rows_of(docs: DataFrame, keys: DataFrame, digest) -> DataFrame:
    """Rows of `docs` whose (doc_id, digest) is in `keys` (k_id, k_digest), one for each key."""
    own = docs.select(whole_row(docs).alias("doc"), F.col("doc_id").alias("own_id"), digest.alias("own_digest"))
    same = F.col("own_id").eqNullSafe(F.col("k_id")) & (F.col("own_digest") == F.col("k_digest"))
    return own.join(keys, same).dropDuplicates(["own_id", "own_digest"]).select("doc.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score at least QUALITY_THRESHOLD. Learned from the labels of documents that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(quality.labelled(quality.with_statistics(docs), labels))
    score = quality.score_column(model, quality.statistics_of("text"))
    return docs.filter(score >= QUALITY_THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest doc_id."""
    kept = exact_dedup.exact_groups(docs, keep="largest").filter("kept")
    keys = kept.select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_digest"))
    return _rows_of(docs, keys, F.sha2(folded("text"), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest doc_id."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("k_digest"))
    groups = simhash_dedup.simhash_groups(rows, ["doc_id", "k_digest"])
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k_digest")).alias("first"))
    keys = first.select(F.col("first.doc_id").alias("k_id"), F.col("first.k_digest").alias("k_digest"))
    return _rows_of(docs, keys, F.xxhash64("text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every piece of a packed sequence."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), with_ids=False)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: Learned scores, drawn blocks and token ids are not SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each result written as Parquet and reread as the documents of the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, f"pipeline-{number}")
    return docs
