"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pageframe.llm.components import components
from pageframe.llm.texts import byte_words, folded, stored
from pageframe.sources.readers import bounded_batches

BITS = 64
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a folded text: a bit is 1 if it is set in over half of the hashes of its word shingles.

    Repeated shingles count again. A text of fewer words has one shingle, all its words; a text without words has
    fingerprint 0.
    """
    words = byte_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n], ends[min(shingle, len(words)) - 1 :], strict=True)
    hashes = np.array([digest(joined[s : e - 1], seed) for s, e in spans], ">u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def simhash(text: Column | str, shingle: int = 3, seed: int = 42) -> Column:
    """Fingerprints of whole texts as a signed long."""

    @pandas_udf("long")
    def of(texts):
        return texts.map(lambda text: fingerprint(text, shingle, seed)).astype("int64")

    return of(folded(text))


def flips(radius: int, groups: int) -> list[tuple[int, list[int]]]:
    """For each group of bits: the bits that are kept, and what is flipped in them to get all keys of a fingerprint.

    Two fingerprints that differ in at most `radius` bits meet in the middle if each emits all variants within half
    the radius. An odd radius has no middle, so the bits are cut into groups, and a group is blanked in each turn: a
    differing bit lies in one of them at least, and with that group blank the rest differs in an even radius - 1.
    """
    half = radius // 2
    turns = [(0, BITS)] if radius % 2 == 0 else None
    if turns is None:
        cuts = np.linspace(0, BITS, groups + 1).astype(int)
        turns = list(zip(cuts[:-1], cuts[1:], strict=True))
    out = []
    for number, (lo, hi) in enumerate(turns):
        blank = 0 if radius % 2 == 0 else ((1 << int(hi - lo)) - 1) << int(lo)
        free = [b for b in range(BITS) if not blank >> b & 1]
        ball = [0]
        for _ in range(half):
            ball = sorted({x ^ bit for x in ball for bit in [0, *(1 << b for b in free)]})
        tag = number << int(lo) if blank else 0
        out.append((~blank & (2**BITS - 1), [x | tag for x in ball]))
    return out


def near_pairs(prints: DataFrame, radius: int = 3, groups: int = 3) -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints that differ in at most `radius` bits, once each.

    `prints` has a column `print` of distinct fingerprints. Each emits its variants (see `flips`), the variants are
    shuffled and sorted, and of every run of equal keys the pairs are verified. A run holds only fingerprints of one
    ball, so it stays small however many documents share a fingerprint.
    """
    masks = [(np.uint64(mask), np.array(ball, np.uint64)) for mask, ball in flips(radius, groups)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(values), 4096):
                part = values[at : at + 4096]
                for mask, ball in masks:
                    keys = ((part & mask)[:, None] ^ ball[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), pa.array(np.repeat(part, len(ball)).view(np.int64))], ["key", "print"]
                    )

    keyed = prints.select("print").mapInArrow(emit, "key long, print long")
    met = keyed.repartition("key").sortWithinPartitions("key", "print")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = values = np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            values = np.concatenate([values, batch.column(1).to_numpy()])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last run may go on
            yield from _pairs_of_runs(keys[:cut], values[:cut], radius)
            keys, values = keys[cut:], values[cut:]
        yield from _pairs_of_runs(keys, values, radius)

    return met.mapInArrow(verify, "a long, b long").distinct()


def _pairs_of_runs(keys: np.ndarray, values: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """Verified pairs of values under equal neighbouring keys: each value with the one 1, 2, 3, … places further on."""
    at = np.arange(len(keys))
    distance = 1
    while True:
        at = at[: np.searchsorted(at, len(keys) - distance)]
        at = at[keys[at] == keys[at + distance]]
        if not len(at):
            return
        a, b = values[at], values[at + distance]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
        if near.any():
            yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], ["a", "b"])
        distance += 1


def simhash_groups(
    docs: DataFrame,
    keys: list[str],
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 3,
    seed: int = 42,
    groups: int = 3,
) -> DataFrame:
    """(keys, print, component): every row with its fingerprint and the smallest fingerprint it reaches over links.

    Fingerprints link at `radius` or fewer differing bits. Rows of one fingerprint are one node however many they
    are. A null text counts as empty; texts without words share fingerprint 0 and link like any others.
    """
    rows = stored(
        bounded_batches(docs).select(*keys, simhash(F.col(text_col), shingle, seed).alias("print")), "simhash-prints"
    )
    pairs = near_pairs(rows.select("print").distinct(), radius, groups)
    linked = components(pairs).select(F.col("node").alias("print"), "root")
    joined = rows.join(linked, "print", "left")
    return joined.select(*keys, "print", F.coalesce("root", "print").alias("component"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, fingerprint, component_id, kept): 16 lowercase hex digits, and the smallest id reachable over links.

    Rows of a null id get the component of their fingerprint; `component_id` is null where no row has an id.
    """
    rows = simhash_groups(docs, [id_col], text_col, **options)
    # stored, so that the join with a component of very many rows can be split
    smallest = stored(rows.groupBy("component").agg(F.min(id_col).alias("component_id")), "simhash-components")
    return rows.join(smallest, "component").select(
        id_col,
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)).alias("kept"),
    )
