"""What the text operators share: fixed patterns, case folding, stored tables, words in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.sources.checkpoints import run_folder

# What a word is, and which letters are folded.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def folded(text: Column | str) -> Column:
    """Lower case for A-Z only; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def word_count(text: Column | str) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df`, written once to the session's shared folder and read back. Survives the loss of any executor."""
    spark = df.sparkSession
    path = run_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so names of their own cannot clash with those that an operator adds."""
    return F.struct(*[F.col(f"`{name}`") for name in df.columns])


def small_batches(batches: Iterator[pa.RecordBatch], max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that one holds at most about `max_bytes`; a single longer row stays whole."""
    for batch in batches:
        parts = max(1, min(batch.num_rows, -(-batch.nbytes // max_bytes)))
        step = -(-batch.num_rows // parts) or 1
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def byte_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8. bytes.split() cuts at just the characters that WORD leaves out."""
    return text.encode().split() if text else []


def ragged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One flat array and the offsets of its parts."""
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return (np.concatenate(lists) if lists else np.zeros(0, np.int64)), offsets
