"""Substring dedup by level-wise doubling."""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.llm.texts import WORD, byte_words, ragged, small_batches, stored

#: Texts hashed at once, in bytes.
BATCH_BYTES = 2 << 20
#: There are fewer representatives of a crowd of rows than this.
MOST_CROWDS = 100_000
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of every word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of two hashes in their order."""
    z = x * _K1
    z ^= ((y << np.uint64(31)) | (y >> np.uint64(33))) * _K2
    z ^= z >> np.uint64(29)
    z *= _K3
    z ^= z >> np.uint64(32)
    return z


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of `length` words, by doubling: two windows make one of twice their length.

    A length that is no power of two is two overlapping windows. The result is as long as the windows are many.
    """
    hashes, size = words, 1
    while size * 2 <= length:
        hashes = _pair(hashes[:-size], hashes[size:]) if len(hashes) > size else hashes[:0]
        size *= 2
    gap = length - size
    if gap:
        hashes = _pair(hashes[:-gap], hashes[gap:]) if len(hashes) > gap else hashes[:0]
    return hashes


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """`best` (np.minimum, np.maximum) of every `width` neighbours."""
    size = 1
    while size * 2 <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    gap = width - size
    return best(values[:-gap], values[gap:]) if gap else values


#: Anchors whose possible starts are in work at once.
STRIP = 1 << 15


def anchors(hashes: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The short windows that stand for long ones: (position in the flat words, hash, lo, hi).

    A long window is represented by the short window of the smallest hash inside it (by all of them in a tie), so
    equal long windows have equal representatives at equal places, and a long window can only repeat where its
    representative repeats. lo and hi are the first and the last long window, as flat starts, that an anchor
    represents; those between are represented by it too.
    """
    base = (window + 3) // 4
    inside = window - base + 1
    n = int(offsets[-1])
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none.astype(np.uint64), none, none
    short = window_hashes(hashes, base)
    least = _sliding(short, inside, np.minimum)
    starts = np.arange(len(least))
    ends = offsets[np.searchsorted(offsets, starts, side="right")]
    whole = starts + window <= ends  # long windows inside one document
    cover = np.zeros(len(short) + inside - 1, np.uint64)
    cover[inside - 1 : inside - 1 + len(least)] = np.where(whole, least, np.uint64(0))
    at = np.flatnonzero(_sliding(cover, inside, np.maximum)[: len(short)] == short)
    # Of an anchor's possible starts those count whose smallest hash is its own; a strip of anchors is looked at at once.
    steps = np.arange(inside)[::-1]
    kept = []
    for strip in (at[i : i + STRIP] for i in range(0, len(at), STRIP)):
        spans = strip[:, None] - steps[None, :]
        clipped = np.clip(spans, 0, len(least) - 1)
        mine = (spans == clipped) & whole[clipped] & (least[clipped] == short[strip][:, None])
        some = mine.any(axis=1)
        strip, spans, mine = strip[some], spans[some], mine[some]
        rows = np.arange(len(strip))
        last = inside - 1 - mine[:, ::-1].argmax(axis=1)
        kept.append((strip, spans[rows, mine.argmax(axis=1)], spans[rows, last]))
    at, lo, hi = (np.concatenate([none, *parts]) for parts in (list(zip(*kept, strict=True)) or [(), (), ()]))
    return at, short[at], lo, hi


def _context(lane: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int) -> np.ndarray:
    """Hash of all the words that the windows of an anchor cover, and of where the anchor lies in them."""
    half = 1 << (window.bit_length() - 1)
    long = window_hashes(lane, half)
    mid = np.minimum(lo + half, hi + window - half)
    ends = _pair(_pair(long[lo], long[mid]), long[hi + window - half])
    return _pair(ends, ((at - lo) * 65536 + (hi - lo)).astype(np.uint64))


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _scan(window: int):
    """A row a text: words, digest of all words, and its anchors with their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BATCH_BYTES):
            words = [byte_words(text) for text in batch.column("text").to_pylist()]
            flat, offsets = ragged([np.arange(len(w)) for w in words])
            hashes = word_hashes([w for ws in words for w in ws]) if len(flat) else np.zeros((0, 2), np.uint64)
            at, short, lo, hi = anchors(hashes[:, 0].copy(), offsets, window)
            context = _context(hashes[:, 1].copy(), at, lo, hi, window) if len(at) else short
            doc = np.searchsorted(offsets, at, side="right") - 1
            counts = np.bincount(doc, minlength=len(words))
            arrays = [
                batch.column("k1"),
                batch.column("k2"),
                batch.column("id"),
                pa.array(np.diff(offsets), pa.int64()),
                pa.array([_digest(w) for w in words], pa.string()),
                _lists(_signed(short), counts, pa.int64()),
                _lists(_signed(context), counts, pa.int64()),
                _lists(at - offsets[doc], counts, pa.int32()),
                _lists(at - lo, counts, pa.int32()),
                _lists(at - hi, counts, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "id", "n_words", "sha", "short", "context", "at", "lo", "hi"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors in the order (short, context, row, at): those whose short hash repeats, marked.

    whole: the same neighbourhood is there again. one: the first of its neighbourhood, in a group of several. Of the
    stream one row is held back to see its successor, and one, the first of a group, to see a second neighbourhood.
    """
    delayed: dict[str, np.ndarray] | None = None
    before: tuple[int, int] | None = None
    held: dict[str, np.ndarray] | None = None

    def out(rows: dict[str, np.ndarray], whole, one) -> pa.RecordBatch:
        columns = [*rows.values(), np.broadcast_to(whole, len(rows["row"])), np.broadcast_to(one, len(rows["row"]))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*rows, "whole", "one"])

    def step(rows: dict[str, np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal delayed, before, held
        short, context = rows["short"], rows["context"]
        n = len(short)
        new_run, new_context = np.ones(n, bool), np.ones(n, bool)
        new_run[1:] = short[1:] != short[:-1]
        new_context[1:] = new_run[1:] | (context[1:] != context[:-1])
        if before is not None:
            new_run[0] = short[0] != before[0]
            new_context[0] = new_run[0] or context[0] != before[1]
        ends_run, ends_context = np.append(new_run[1:], True), np.append(new_context[1:], True)
        decided = n if last else n - 1
        repeated = ~new_run | ~ends_run
        whole = ~new_context | ~ends_context
        starts = np.flatnonzero(new_context)
        following = np.append(starts[1:], -1)
        one = new_context & ~new_run
        for_first = new_run[starts]
        one[starts[for_first]] = (following[for_first] >= 0) & ~new_run[following[for_first]]
        if held is not None and len(starts):
            yield out(held, held.pop("is_whole"), not new_run[starts[0]])
            held = None
        # The first row of a run that has shown no second neighbourhood yet waits.
        wait = int(starts[-1]) if len(starts) and new_run[starts[-1]] and not last else -1
        keep = repeated.copy()
        keep[decided:] = False
        if 0 <= wait < decided:
            keep[wait] = False
            if repeated[wait]:
                held = {k: v[wait : wait + 1] for k, v in rows.items()} | {"is_whole": whole[wait]}
        if keep.any():
            yield out({k: v[keep] for k, v in rows.items()}, whole[keep], one[keep])
        if decided:
            before = (int(short[decided - 1]), int(context[decided - 1]))
        delayed = None if last else {k: v[-1:] for k, v in rows.items()}

    for batch in batches:
        if batch.num_rows:
            rows = {name: column.to_numpy() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
            if delayed is not None:
                rows = {k: np.concatenate([delayed[k], v]) for k, v in rows.items()}
            yield from step(rows, last=False)
    if delayed is not None:
        yield from step(delayed, last=True)
    if held is not None:
        yield out(held, held.pop("is_whole"), False)


def _extend(window: int):
    """For anchors of a text: hashes of twice their length on both sides, and of all their long windows."""
    base = (window + 3) // 4
    half = 2 * base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BATCH_BYTES):
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                lanes = word_hashes(byte_words(text))
                middle = _signed(window_hashes(lanes[:, 0].copy(), half))
                long = _signed(window_hashes(lanes[:, 1].copy(), window))
                for f in found:
                    at = f["at"]
                    left, right = at - (half - base), at
                    out.append(
                        (
                            f["short"],
                            f["row"],
                            at,
                            f["lo"],
                            f["whole"],
                            int(middle[left]) if left >= 0 else None,
                            int(middle[right]) if right < len(middle) else None,
                            long[at - f["lo"] : at - f["hi"] + 1],
                        )
                    )
            if out:
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), EXTENDED.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=list(EXTENDED))

    return run


EXTENDED = {
    "short": pa.int64(),
    "row": pa.int64(),
    "at": pa.int32(),
    "lo": pa.int32(),
    "whole": pa.bool_(),
    "left": pa.int64(),
    "right": pa.int64(),
    "long": pa.list_(pa.int64()),
}
EXTENDED_DDL = "short long, row long, at int, lo int, whole boolean, left long, right long, long array<long>"


def _runs_of_places(backs: list[int], window: int) -> list[tuple[int, int]]:
    """Distances of repeated windows from their anchor, falling, as runs (farthest, nearest) of neighbours."""
    out: list[tuple[int, int]] = []
    for back in backs:
        if out and out[-1][1] - back <= window:  # windows so close cover all that is between them
            out[-1] = (out[-1][0], back)
        else:
            out.append((back, back))
    return out


def _repeated_inside(group: list[dict], window: int) -> list[tuple[int, int, int]]:
    """Levels 2 and 3 in a group of neighbourhoods of one anchor: (row, start, end) of what repeats, in words.

    A window is looked at if the anchor's extension on its side, twice as long, repeats (level 2), and repeats itself
    if another neighbourhood has the same window at the same distance (level 3).
    """
    base = (window + 3) // 4
    turn = base  # windows that begin at least so far before the anchor hold its extension to the left
    sides = {side: Counter(g[side] for g in group if g[side] is not None) for side in ("left", "right")}
    seen: Counter = Counter()
    open_windows = []
    for g in group:
        windows = []
        for i, value in enumerate(g["long"]):
            back = g["lo"] - i
            side = "left" if back >= turn else "right"
            if sides[side][g[side]] > 1:
                windows.append((back, value))
        seen.update(windows)
        open_windows.append(windows)
    spans = []
    for g, windows in zip(group, open_windows, strict=True):
        if not g["whole"]:
            for far, near in _runs_of_places([back for back, value in windows if seen[back, value] > 1], window):
                spans.append((g["row"], g["at"] - far, g["at"] - near + window))
    return spans


def _verdicts(window: int, most: int):
    """Groups of extended anchors, in the order of their short hash: spans, or the rows themselves of a large group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, large = None, [], False
        names = ["row", "start", "end", *(f"x_{name}" for name in EXTENDED)]
        kinds = [pa.int64(), pa.int32(), pa.int32(), *EXTENDED.values()]

        def emit(spans: list[tuple], rows: list[dict]) -> Iterator[pa.RecordBatch]:
            if spans or rows:
                table = [[*span, *[None] * len(EXTENDED)] for span in spans]
                table += [[None, None, None, *(row[name] for name in EXTENDED)] for row in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*table, strict=True), kinds, strict=True)], names)

        for batch in batches:
            spans, rows = [], []
            for record in batch.to_pylist():
                if record["short"] != key:
                    spans.extend([] if large else _repeated_inside(group, window))
                    key, group, large = record["short"], [], False
                group.append(record)
                if large or len(group) > most:
                    rows.extend(group)
                    group, large = [], True
            yield from emit(spans, rows)
        yield from emit([] if large else _repeated_inside(group, window), [])

    return run


CUTS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
CUTS_DDL = "array<struct<start:int,end:int>>"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the spans (pairs of start and end, in words) out of each text; those that touch are one."""
    for batch in small_batches(batches):
        removed, digests, cuts = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = byte_words(text)
            gone = np.zeros(len(words) + 1, np.int64)
            for span in spans:
                gone[span["start"]] += 1
                gone[span["end"]] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            removed.append(int(gone.sum()))
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).tolist()
            cuts.append([{"start": start, "end": end} for start, end in zip(edges[::2], edges[1::2], strict=True)])
            digests.append(_digest([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("k1"), batch.column("k2"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(cuts, CUTS)],
            names=["k1", "k2", "removed", "kept", "cuts"],
        )


def _large_groups(rows: DataFrame, window: int) -> DataFrame:
    """Levels 2 and 3 as `_repeated_inside` does them, for groups of any size: (row, start, end)."""
    base = (window + 3) // 4
    sides = rows.select("short", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left").alias("h")), F.struct(F.lit("right").alias("side"), F.col("right").alias("h")))).alias("s")).select("short", "s.*")
    level2 = sides.filter("h is not null").groupBy("short", "side", "h").count().filter("count > 1").drop("count")
    every = rows.select("short", "row", "at", "whole", "left", "right", "lo", F.posexplode("long").alias("i", "value")).withColumn("back", F.col("lo") - F.col("i"))
    every = every.withColumn("side", F.when(F.col("back") >= base, "left").otherwise("right")).withColumn("h", F.when(F.col("back") >= base, F.col("left")).otherwise(F.col("right")))
    level3 = stored(every.join(stored(level2, "substring-sides"), ["short", "side", "h"], "left_semi").select("short", "row", "at", "whole", "back", "value"), "substring-level3")
    same = ["short", "back", "value"]
    repeated = stored(level3.groupBy(*same).count().filter("count > 1").drop("count"), "substring-repeated")
    found = level3.filter("not whole").join(repeated, same, "left_semi")
    return found.select("row", (F.col("at") - F.col("back")).alias("start"), (F.col("at") - F.col("back") + window).alias("end"))


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, group_rows: int = 20_000
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, cuts): every word goes that a repeated window of `window` words covers.

    `cuts` are the words that go, as (start, end) from 0 on; `without_cuts` makes the text that stays.

    Level-wise doubling. Level 1 looks at windows of a quarter of the length, and of these only at one representative
    for each long window (see `anchors`), so its shuffle holds a fourteenth of the positions and yet loses nothing.
    Representatives whose whole neighbourhood repeats are done. Of the others, one for each different neighbourhood of
    a repeated representative is extended to twice its length (level 2), and what repeats there to the whole length
    (level 3); both are compared among the neighbourhoods of one representative, in a task up to `group_rows` of them
    and by counting joins beyond. Thousands of copies are one neighbourhood there. Level 1 streams through the rows of
    a representative, holding two; representatives of a crowd of rows are counted before the shuffle and joined, with
    unique keys on one side, so skew handling can split them. A representative and its neighbourhood, or its long window, are told
    apart by two independent hashes of 64 bits each.

    Windows are judged on the input. Texts of fewer words than `window`, empty and null ones lose nothing. Rows that
    repeat, with or without an id, count as any other copies. No rows give no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.xxhash64(F.col(id_col), text).alias("k1"),
        F.xxhash64(F.lit(7), text, F.col(id_col)).alias("k2"),
        F.col(id_col).alias("id"),
        text.alias("text"),
    )
    id_ddl = docs.schema[id_col].dataType.simpleString()
    scan_ddl = (
        f"k1 long, k2 long, id {id_ddl}, n_words long, sha string, short array<long>, context array<long>, "
        "at array<int>, lo array<int>, hi array<int>"
    )
    scanned = rows.mapInArrow(_scan(window), scan_ddl)
    base = stored(scanned.withColumn("row", F.monotonically_increasing_id()), "substring-scan")
    every = base.select("row", F.explode(F.arrays_zip("short", "context", "at", "lo", "hi")).alias("a")).select(
        "a.short", "a.context", "row", "a.at", "a.lo", "a.hi"
    )
    # Representatives that fill more than a hundred-thousandth of all rows go another way, so there are fewer of them
    # than that, whatever the input, and their list is small enough to be sent to every task.
    total = base.agg(F.sum(F.size("short"))).first()[0] or 0
    crowded = every.groupBy("short").count().filter(F.col("count") > max(group_rows, total // MOST_CROWDS)).select("short")
    crowded = F.broadcast(stored(crowded, "substring-crowded"))
    level1 = stored(
        every.join(crowded, "short", "left_anti")
        .repartition("short")
        .sortWithinPartitions("short", "context", "row", "at")
        .mapInArrow(_runs, "short long, context long, row long, at int, lo int, hi int, whole boolean, one boolean"),
        "substring-level1",
    )
    crowd = stored(every.join(crowded, "short", "left_semi"), "substring-crowd")
    contexts = stored(
        crowd.groupBy("short", "context").agg(F.count("*").alias("n"), F.min(F.struct("row", "at", "lo", "hi")).alias("one")),
        "substring-contexts",
    )
    # Of rows that repeat in id and text one is worked on; the result goes to all of them.
    keys = stored(base.groupBy("k1", "k2").agg(F.min("row").alias("row")), "substring-keys")
    wanted = keys.join(level1.select("row").union(crowd.select("row")).distinct(), "row", "left_semi")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"substring_texts_{uuid.uuid4().hex}"
    # Bucketed by the key of a text, so texts are shuffled once and not for every join with what was found.
    (
        rows.join(wanted, ["k1", "k2"])
        .dropDuplicates(["k1", "k2"])
        .select("k1", "k2", "row", "text")
        .write.bucketBy(n, "k1", "k2")
        .option("compression", "zstd")
        .saveAsTable(name)
    )
    try:
        texts = spark.table(name)

        def extended(ones: DataFrame) -> DataFrame:
            found = F.collect_list(F.struct("short", "row", "at", "lo", "hi", "whole")).alias("found")  # of one text
            sources = ones.join(keys, "row").groupBy("k1", "k2").agg(found)
            return texts.join(sources, ["k1", "k2"]).select("text", "found").mapInArrow(_extend(window), EXTENDED_DDL)

        x_ddl = ", ".join(f"x_{part.strip()}" for part in EXTENDED_DDL.split(","))
        verdicts = stored(
            extended(level1.filter("one"))
            .repartition("short")
            .sortWithinPartitions("short")
            .mapInArrow(_verdicts(window, group_rows), f"row long, start int, end int, {x_ddl}"),
            "substring-verdicts",
        )
        large = verdicts.filter("row is null").select(*[F.col(f"x_{c}").alias(c) for c in EXTENDED])
        ones = contexts.select("short", "one.*", (F.col("n") > 1).alias("whole"))
        large = stored(large.unionByName(extended(ones)), "substring-large")
        copies = contexts.filter("n > 1").select("short", "context")
        whole = level1.filter("whole").select("row", "at", "lo", "hi").unionByName(
            crowd.join(copies, ["short", "context"], "left_semi").select("row", "at", "lo", "hi")
        )
        whole = whole.select("row", (F.col("at") - F.col("lo")).alias("start"), (F.col("at") - F.col("hi") + window).alias("end"))
        spans = whole.unionByName(verdicts.filter("row is not null").select("row", "start", "end")).unionByName(_large_groups(large, window))
        per_text = spans.join(keys, "row").groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        changed = stored(
            texts.join(per_text, ["k1", "k2"])
            .select("k1", "k2", "text", "spans")
            .mapInArrow(_remove, f"k1 long, k2 long, removed long, kept string, cuts {CUTS_DDL}"),
            "substring-changed",
        )
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return (
        base.select("k1", "k2", "id", "n_words", "sha")
        .join(changed, ["k1", "k2"], "left")
        .select(
            F.col("id").alias(id_col),
            "n_words",
            F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
            F.coalesce("kept", "sha").alias("kept_sha256"),
            F.coalesce("cuts", F.array().cast(CUTS_DDL)).alias("cuts"),
        )
    )


def without_cuts(text: Column | str, cuts: Column | str) -> Column:
    """The words of a text outside its cuts, joined by one space."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"))
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["end"]))

    def kept(all_words: Column) -> Column:
        ends = F.concat(F.transform(cuts, lambda c: c["start"]), F.array(F.size(all_words)))
        return F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.slice(all_words, p["a"] + 1, p["b"] - p["a"])))

    return F.array_join(F.flatten(F.transform(F.array(words), kept)), " ")
