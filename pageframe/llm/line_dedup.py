"""Line dedup: segment-partition edit join over the lines of all documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.llm.components import components
from pageframe.llm.texts import small_batches, stored

#: Edits that two lines may differ in, and the characters a line needs for that; shorter lines must be equal.
MOST_EDITS, LEAST_CHARS = 2, 24
#: Rows of a bucket that are compared with each other at once.
BLOCK = 256
WORD = 64
#: Bits of the filter that lines are fetched by: 4 MB.
FILTER_BITS = 1 << 25


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments that lines of this length are cut into; later ones take the rest."""
    parts = edits + 1
    short, longer = length // parts, length % parts
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


def probes(length: int, other: int, edits: int) -> list[tuple[int, int, int]]:
    """(segment, start, length) of all substrings of a line that can equal a segment of a line of `other` characters.

    If `edits` edits turn one line into the other, one of edits + 1 segments is untouched; of the first such segment
    the earlier ones each took an edit or more, which bounds how far it can have moved from the left, and the later
    ones how far from the right.
    """
    out = []
    shift = length - other
    for i, (at, size) in enumerate(segments(other, edits)):
        low = max(at - i, at + shift - (edits - i), 0)
        high = min(at + i, at + shift + (edits - i), length - size)
        out.extend((i, start, size) for start in range(low, high + 1))
    return out


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance of two strings, or `most` + 1 if it is larger.

    What both begin and end with is cut off; the rest is a bit-parallel band: a column of the distance matrix is held
    as the signs of its vertical differences in one word of 2 * most + 1 bits around the diagonal, and one step of a
    few word operations moves on to the next column.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    lead = _common(a, b, n)
    tail = _common(a[lead:][::-1], b[lead:][::-1], n - lead)
    a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    if not a or not b:
        d = max(len(a), len(b))
        return d if d <= most else most + 1
    return _banded(a, b, most)


def _common(a: str, b: str, n: int) -> int:
    """Length of the common prefix of two strings, up to n."""
    low, high = 0, n
    if a[:n] == b[:n]:
        return n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _banded(a: str, b: str, most: int) -> int:
    """The band of `edit_distance`.

    Bit WORD - 1 of column j is row j + most of the longer string and lower bits are the rows above it, so the band
    moves down a row with every column. The distance is followed down the lowest diagonal of the band until the last
    row is reached, and then along that row.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n <= 2 * most:
        return _plain(a, b, most)
    full, top = (1 << WORD) - 1, 1 << (WORD - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    vp, vn = full & ~((1 << (WORD - most - 1)) - 1), 0
    score, row = most, top >> 1
    for j, c in enumerate(b):
        shift = j + most + 1 - WORD
        eq = places.get(c, 0)
        eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        d0 = (((eq & vp) + vp) ^ vp | eq | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if j < n - most:
            score += not d0 & top
            if score > 2 * most + m - n + most:  # even if all that is left were equal
                return most + 1
        else:
            score += bool(hp & row) - bool(hn & row)
            row >>= 1
        vp, vn = (hn | ~(d0 >> 1 | hp)) & full, d0 >> 1 & hp
    return min(score, most + 1)


def _plain(a: str, b: str, most: int) -> int:
    """Edit distance of strings not longer than a band, row by row."""
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row[-1], most + 1)


def _seed(length: int, segment: int) -> int:
    return length << 8 | segment


@lru_cache(100_000)
def key_plan(length: int, edits: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(seed, start, end) of what a line probes shorter or equal lines with, and of its own segments."""
    looks = [
        (_seed(other, i), start, start + size)
        for other in range(max(length - edits, 0), length + 1)
        for i, start, size in probes(length, other, edits)
    ]
    return looks, [(_seed(length, i), start, start + size) for i, (start, size) in enumerate(segments(length, edits))]


def line_keys(line: str, edits: int) -> dict[int, bool]:
    """Keys of a line: hashes of its own segments (True, the index) and of the substrings it probes with."""
    digest = xxhash.xxh64_intdigest
    looks, own = key_plan(len(line), edits)
    out = {digest(line[start:end], seed): False for seed, start, end in looks}
    for seed, start, end in own:
        out[digest(line[start:end], seed)] = True
    return out


def first_key(index: str, probe: str, edits: int) -> int | None:
    """The key of the first segment of `index` that `probe` holds at a place where a probe looks."""
    spans = segments(len(index), edits)
    for i, start, size in probes(len(probe), len(index), edits):
        at = spans[i][0]
        if probe[start : start + size] == index[at : at + size]:
            key = xxhash.xxh64_intdigest(index[at : at + size], _seed(len(index), i))
            return key - (1 << 64) if key >> 63 else key
    return None


def _emit_keys(edits: int, least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            lines = {line for text in batch.column(0).to_pylist() if text for line in text.split("\n")}
            keys, ids, own = [], [], []
            for line in lines:
                if len(line) >= least_chars and line.strip():
                    found = line_keys(line, edits)
                    keys.extend(found)
                    own.extend(found.values())
                    ids.extend([xxhash.xxh64_intdigest(line, 42)] * len(found))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, ids)]
            yield pa.RecordBatch.from_arrays([signed[0], pa.array(own, pa.bool_()), signed[1]], names=["key", "own", "id"])

    return run


def _keep_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order (key, index first, id): those of keys with an index row and rows of two lines."""
    held = None  # the first row of the run that may go on, while only its line is known
    met_key = None

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        own = batch.column("own").to_numpy(zero_copy_only=False)
        ids = batch.column("id").to_numpy()
        if held is not None and held[0] == keys[0]:
            keys, own, ids = np.insert(keys, 0, held[0]), np.insert(own, 0, held[1]), np.insert(ids, 0, held[2])
        held = None
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        several = (np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)) & own[starts]
        if met_key == keys[0]:
            several[0] = True
        if several[-1]:
            met_key = keys[-1]
        elif own[starts[-1]]:
            held = (int(keys[-1]), True, int(ids[-1]))
        keep = np.repeat(several, sizes)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(own[keep]), pa.array(ids[keep])], ["key", "own", "id"])


def _id_filter(met: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits with those of the ids in `met`; of fixed size, whatever their number.

    A bit that is not set says that a line is not wanted. With very many ids most bits are set: then more lines move
    than are wanted, and results stay the same.
    """
    spot = met.select((F.pmod("id", F.lit(FILTER_BITS)) + 1).alias("spot"))
    parts = spot.groupBy(F.expr("bitmap_bucket_number(spot)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(spot))").alias("bits")
    )
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in parts.collect():  # FILTER_BITS / 8 bytes at most
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        bits[(row["bucket"] - 1) * len(part) : row["bucket"] * len(part)] = part
    return bits


def _wanted_lines(bits: np.ndarray, least_chars: int):
    """Lines whose bit is set, once a batch, with their id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            lines = list({x for text in batch.column(0).to_pylist() if text for x in text.split("\n") if len(x) >= least_chars})
            ids = np.array([xxhash.xxh64_intdigest(x, 42) for x in lines], np.uint64)
            spots = (ids % np.uint64(FILTER_BITS)).astype(np.int64)
            wanted = np.flatnonzero(bits[spots >> 3] >> (spots & 7).astype(np.uint8) & 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[wanted].view(np.int64)), pa.array([lines[i] for i in wanted], pa.string())], names=["id", "line"]
            )

    return run


def _compare(edits: int):
    """Verified links of each bucket, or pair of blocks of one: their number for each line, and trees of links."""

    def links_of(key: int, rows: list[tuple]) -> list[tuple[int, int, int]]:
        # rows: (node, own, line, block), i, j are the blocks of this pair
        (_, i, j), members = key, rows
        counts: dict[int, int] = {}
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for node, own, line, block in members:
            if not own:
                continue
            for other, _, text, its in members:
                if node == other or {block, its} != {i, j} or not 0 <= len(text) - len(line) <= edits:
                    continue
                if len(text) == len(line) and other < node:
                    continue
                if first_key(line, text, edits) == key[0] and edit_distance(line, text, edits) <= edits:
                    counts[node] = counts.get(node, 0) + 1
                    counts[other] = counts.get(other, 0) + 1
                    low, high = sorted((root(node), root(other)))
                    parent[high] = low
        return [(x, x, n) for x, n in counts.items()] + [(x, root(x), 0) for x in parent if root(x) != x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            found = []
            for k, i, j, node, own, line, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, i, j) != key:
                    if len(rows) > 1:
                        found.extend(links_of(key, rows))
                    key, rows = (k, i, j), []
                rows.append((node, own, line, block))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b", "links"])
        if len(rows) > 1 and (found := links_of(key, rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b", "links"])

    return run


def similar_lines(docs: DataFrame, text_col: str = "text", edits: int = MOST_EDITS, least_chars: int = LEAST_CHARS, block: int = BLOCK) -> DataFrame:
    """(line_md5, class_md5, n_links) of every line that differs in at most `edits` edits from another line.

    Lines are cut into edits + 1 segments, of which two similar lines share one untouched. Segments are indexed with
    the length of their line and their number; a line probes the lengths down to `edits` below its own, at the places
    a segment can have moved to. Only keys under which an index row meets another line go on, and only their lines
    are fetched, through a bitmap of fixed size; a pair is verified under its first common segment alone, so it counts once. A bucket of many lines
    is cut into blocks and compared by pairs of blocks; links leave it as numbers and trees, not as pairs. The class
    is the line of the smallest internal number that is reachable over links.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = texts.mapInArrow(_emit_keys(edits, least_chars), "key long, own boolean, id long")
    met = keys.repartition("key").sortWithinPartitions("key", F.col("own").desc(), "id").mapInArrow(_keep_met, "key long, own boolean, id long")
    met = stored(met.distinct(), "line-keys")
    lines = texts.mapInArrow(_wanted_lines(_id_filter(met), least_chars), "id long, line string")
    known = stored(
        lines.distinct().select(F.monotonically_increasing_id().alias("node"), "id", "line", F.unhex(F.md5("line")).alias("h")), "line-texts"
    )
    sizes = met.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1")
    spread = (
        met.join(stored(sizes, "line-buckets"), "key", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64(F.lit(5), "id"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "own", "id", "block")
        .join(known.select("id", "node", "line"), "id")
        .select("key", "i", "j", "node", "own", "line", "block")
    )
    found = stored(
        spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(_compare(edits), "a long, b long, links long"),
        "line-links",
    )
    links = found.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    classes = components(found.filter("a <> b")).join(links, "node")
    roots = known.select(F.col("node").alias("root"), F.col("h").alias("class_md5"))
    return classes.join(known.select("node", "h"), "node").join(roots, "root").select(F.col("h").alias("line_md5"), "class_md5", "n_links")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = MOST_EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, n_lines, n_links, n_removed, removed) for every row: lines that repeat, or nearly repeat, an earlier one.

    Lines end at \\n. Two lines are alike when they are equal or, from `least_chars` characters on, differ in at most
    `edits` edits of a character; classes are what is connected over that. Of a class the first line stays, by id of
    its document (null first), row, and place in the text; `removed` holds the places, from 0, of all others in the
    row, in order. Blank lines are never removed and link with nothing. `n_links` adds up the different lines alike
    to a line of the row. Null and empty texts have one blank line. No rows give no rows.
    """
    base = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            F.transform(
                F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.when(x.rlike(r"\S"), F.unhex(F.md5(x)))
            ).alias("lines"),
        ),
        "line-rows",
    )
    classes = stored(similar_lines(docs, text_col, edits, least_chars), "line-classes")
    every = base.select("row", "id", F.posexplode("lines").alias("pos", "h")).filter("h is not null")
    places = every.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("id", "row", "pos")).alias("first"))
    joined = places.join(classes.withColumnRenamed("line_md5", "h"), "h", "left").filter("n > 1 or class_md5 is not null")
    joined = stored(joined.withColumn("class", F.coalesce("class_md5", "h")), "line-places")
    of_class = joined.groupBy("class").agg(F.min("first").alias("stays"))
    decided = stored(joined.join(of_class, "class").select("h", "stays", F.coalesce("n_links", F.lit(0)).alias("n_links")), "line-decided")
    alike = (
        every.join(decided, "h")
        .withColumn("goes", (F.col("stays.row") != F.col("row")) | (F.col("stays.pos") != F.col("pos")))
        .groupBy("row")
        .agg(F.sum("n_links").alias("n_links"), F.array_sort(F.array_compact(F.collect_list(F.when(F.col("goes"), F.col("pos"))))).alias("removed"))
    )
    return base.select("row", "id", F.size("lines").cast("long").alias("n_lines")).join(alike, "row", "left").select(
        F.col("id").alias(id_col),
        "n_lines",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def remove_lines(text: Column | str, removed: Column | str) -> Column:
    """The text without the lines at the places in `removed`."""
    lines = F.split(text, "\n")
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda x: ~F.array_contains(removed, x["i"]))
    return F.array_join(F.transform(kept, lambda x: x["x"]), "\n")
