"""Two tokenizers aligned by bytes: groups, links, and how many documents hold each pair of linked tokens."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, pairwise
from string import punctuation
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageframe.llm import perfect_hash
from pageframe.llm.packing import BYTE_LETTERS, LATIN_END
from pageframe.llm.texts import small_batches, stored
from pageframe.llm.units import forget, per_worker, split_units

#: Characters of a text that are encoded as one part.
SEGMENT = 1 << 18
#: Units of a generation; a Python worker keeps the ids of two of them.
CACHED_UNITS = 250_000
#: Tokens that are aligned at once.
PART_TOKENS = 1 << 17
#: Distinct pairs that a task counts before it sends them on.
TASK_PAIRS = 1 << 19
#: Tasks whose counts one dense vector takes, and vectors that one sum takes.
FAN = 64
#: Pairs whose counts a task looks up at once; more of them are looked up by passes of their own over the documents.
LOOKUP_PAIRS = 1 << 22
BREAK = re.compile(r"(?<=\S)(?= )")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Encoder:
    """Ids of tokenizer A (byte-level, a .json file) and B (pieces, a .model file), for units of a text."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=path_b)
        byte_of = {letter: b for b, letter in BYTE_LETTERS.items()}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = {i: bytes(map(byte_of.__getitem__, token)) for token, i in vocabulary.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(pieces)
        ]
        if any("▁" in piece.lstrip("▁") for piece in pieces) or b"identity" not in self.b.serialized_model_proto():
            raise ValueError("pieces that hold a space behind another character, or a normaliser, forbid to cut texts")
        self.space = self.b.piece_to_id("▁")
        self.kind = "H" if max(max(self.bytes_a), len(pieces)) < 1 << 16 else "I"
        # Marks that no piece holds behind a letter make tokens of their own at the end of a word.
        behind = {mark for piece in pieces for letter, mark in pairwise(piece) if letter.isalpha()}
        self.marks = "".join(c for c in punctuation if c != "'" and c not in behind)
        self.one = len(self.a.encode("x").ids), len(self.b.encode("x"))
        self.lead = BYTE_LETTERS[ord(" ")]
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.units: dict[str, tuple[bytes, bytes] | None] = {}
        self.before: dict[str, tuple[bytes, bytes] | None] = {}
        self.tails: dict[str, tuple[bytes, bytes] | None] = {}

    def carried(self, units: set[str]) -> set[str]:
        """Takes what the generation before knows of new units over; the rest of them."""
        found = units & self.before.keys()
        self.units.update(zip(found, map(self.before.__getitem__, found), strict=True))
        return units - found

    def by_a(self, units: list[str]) -> Iterator[list[int]]:
        merged, lead = self.a.model.tokenize, self.lead
        for unit in units:
            if unit.isalpha() and (unit.isascii() or max(unit) < LATIN_END):  # one pre-token, so the merges can be asked directly
                written = unit if unit.isascii() else unit.encode().decode("latin-1").translate(BYTE_LETTERS)
                yield [token.id for token in merged(lead + written)]
            else:
                yield self.a.encode(" " + unit, add_special_tokens=False).ids

    def tail(self, marks: str) -> tuple[bytes, bytes] | None:
        """Ids of marks that follow a letter."""
        if marks not in self.tails:
            a, b = self.a.encode("x" + marks, add_special_tokens=False).ids[self.one[0] :], self.b.encode("x" + marks)[self.one[1] :]
            same = self.size_b[b].sum() == len(marks)
            self.tails[marks] = (array(self.kind, a).tobytes(), array(self.kind, b).tobytes()) if same else None
        return self.tails[marks]

    def packed(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Lists of ids side by side, where each begins, and each as bytes."""
        flat = np.fromiter(chain.from_iterable(ids), self.kind)
        ends = np.cumsum(list(map(len, ids)))
        starts = np.concatenate([[0], ends[:-1]])
        blob, size = flat.tobytes(), flat.itemsize
        return flat, starts, [blob[lo:hi] for lo, hi in zip((starts * size).tolist(), (ends * size).tolist(), strict=True)]

    def learn(self, units: set[str]) -> None:
        """Ids by A and by B of units without the space in front; None where B's bytes are not the unit's own.

        When a generation of units is full the next begins; a unit of the one before is carried over when it is met.
        """
        if len(self.units) >= CACHED_UNITS:
            self.units, self.before, self.tails = {}, self.units, {}
        known = self.units
        fresh = self.carried(units - known.keys())
        tailed = {}
        for unit in fresh:
            head = unit.rstrip(self.marks)
            if len(head) < len(unit) and head[-1:].isalpha() and head[-1] < LATIN_END:
                tailed[unit] = head
        words = list(fresh - tailed.keys() | self.carried(set(tailed.values()) - known.keys()))
        if words:
            _, _, ids_a = self.packed(list(self.by_a(words)))
            flat, starts, ids_b = self.packed([b or [self.space] for b in self.b.encode(words, num_threads=1)])
            known.update(zip(words, zip(ids_a, ids_b, strict=True), strict=True))
            # All bytes come back but those of U+2581, which B takes for a space.
            sizes = np.array([len(word.encode()) + 1 for word in words])
            for at in np.flatnonzero(np.add.reduceat(self.size_b[flat], starts) != sizes).tolist():
                known[words[at]] = None
        for unit, head in tailed.items():
            word, tail = known[head], self.tail(unit[len(head) :])
            known[unit] = (word[0] + tail[0], word[1] + tail[1]) if word and tail else None

    def segments(self, text: str) -> Iterator[list[str]]:
        """The units of space + text without their leading spaces, a bounded number of characters at a time."""
        text, at = " " + text, 0
        while at < len(text):
            cut = BREAK.search(text, at + SEGMENT)
            end = cut.start() if cut else len(text)
            first, *units = split_units(text[at:end])
            yield [first[1:], *units] if first else units
            at = end

    def parts(self, segments: list[list[str]]) -> list[tuple[bytes, bytes]]:
        """Ids of the segments of a text; none where the bytes of its tokens are not its own, which one unit decides."""
        found = []
        for units in segments:
            known = list(map(self.units.__getitem__, units))
            if None in known:
                return []
            found.append((b"".join([x[0] for x in known]), b"".join([x[1] for x in known])))
        return found

    def rows(self, texts: list[str | None]) -> Iterator[list[tuple[bytes, bytes]]]:
        """The parts of each text. Short texts are learned together, the segments of a long one each on its own."""
        if len(texts) == 1:
            found = []
            for segment in self.segments(texts[0]) if texts[0] else ():
                self.learn(set(segment))
                part = self.parts([segment])
                if not part:
                    found = []
                    break
                found += part
            yield found
            return
        segments = [list(self.segments(text)) if text else [] for text in texts]
        self.learn(set().union(*(units for text in segments for units in text)))
        yield from map(self.parts, segments)


def encoder(path_a: str, path_b: str) -> Encoder:
    return per_worker(("encoder", path_a, path_b), lambda: Encoder(path_a, path_b))


class Sizes(NamedTuple):
    """Bytes of each id of A and of B, and the integers that ids are stored as."""

    a: np.ndarray
    b: np.ndarray
    kind: np.dtype


def byte_sizes(own: Encoder) -> Sizes:
    a = np.zeros(max(own.bytes_a) + 1, np.int64)
    a[list(own.bytes_a)] = [len(x) for x in own.bytes_a.values()]
    return Sizes(a, np.array([len(x) for x in own.bytes_b], np.int64), np.dtype(own.kind))


class Written:
    """Every id with what may follow it, as rows of ASCII letters: `id,` and `id|` of A, from `offset` on `id,` and `id;` of B."""

    def __init__(self, sizes: Sizes):
        self.offset = 2 * len(sizes.a)
        words = [f"{i}{end}" for side, ends in ((sizes.a, ",|"), (sizes.b, ",;")) for i in range(len(side)) for end in ends]
        words = np.array(words, "S")
        self.letters = words.view(np.uint8).reshape(len(words), words.dtype.itemsize)
        self.lengths = np.strings.str_len(words)


class Aligned:
    """Parts of texts aligned by their bytes, side by side: each part ends with tokens of both."""

    def __init__(self, parts: list[tuple[bytes, bytes]], sizes: Sizes):
        self.a, self.b = (np.frombuffer(b"".join(side), sizes.kind).astype(np.int64) for side in zip(*parts, strict=True))
        self.counts_a, self.counts_b = (np.array([len(x) // sizes.kind.itemsize for x in side]) for side in zip(*parts, strict=True))
        ends_a, ends_b = np.cumsum(sizes.a[self.a]), np.cumsum(sizes.b[self.b])
        ends = np.concatenate([ends_a, ends_b])
        order = ends.argsort(kind="stable")  # two runs in order
        ends = ends[order]
        last = np.flatnonzero(np.concatenate([ends[1:] != ends[:-1], [True]]))
        ends = ends[last]
        upto_a = np.cumsum(order < len(self.a))[last]
        upto_b = last + 1 - upto_a
        # What lies between two neighbouring ends is in one token of A and one of B: a link.
        at_a, at_b = np.concatenate([[0], upto_a[:-1]]), np.concatenate([[0], upto_b[:-1]])
        self.link_a = self.a[at_a]
        self.pairs = self.link_a * len(sizes.b) + self.b[at_b]
        self.part_ends = ends_a[np.cumsum(self.counts_a) - 1]
        self.part = np.searchsorted(self.part_ends, ends)
        self.by_end_a, self.by_end_b = upto_a > at_a, upto_b > at_b  # a token of A, of B ends with the link
        self.is_group = self.by_end_a & self.by_end_b
        self.groups = ends[self.is_group]

    def by_part(self, values: np.ndarray) -> list[int]:
        """Sums of a value of each link."""
        sums = np.concatenate([[0], np.cumsum(values)])
        return np.diff(sums[np.searchsorted(self.part, np.arange(len(self.part_ends) + 1))]).tolist()

    def texts(self, written: Written) -> list[np.ndarray]:
        """The groups of each part as ASCII, with a last semicolon."""
        group = np.cumsum(self.is_group) - self.is_group
        group_a, group_b = group[self.by_end_a], group[self.by_end_b]
        upto_a, upto_b = (np.cumsum(np.bincount(of, minlength=len(self.groups))) for of in (group_a, group_b))
        place_a = np.arange(len(self.a)) + np.concatenate([[0], upto_b])[group_a]
        place_b = np.arange(len(self.b)) + upto_a[group_b]
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[place_a] = 2 * self.a + self.is_group[self.by_end_a]
        order[place_b] = 2 * self.b + self.is_group[self.by_end_b] + written.offset
        letters = written.letters[order]
        ends = np.cumsum(written.lengths[order])[np.cumsum(self.counts_a + self.counts_b) - 1]
        return np.split(letters[letters > 0], ends[:-1])


def _grouped(rows: list, tokens: Callable[[object], int]) -> Iterator[list]:
    """Consecutive rows together as long as they hold no more than PART_TOKENS; a longer row stands alone."""
    group, held = [], 0
    for row in rows:
        size = tokens(row)
        if group and held + size > PART_TOKENS:
            yield group
            group, held = [], 0
        group.append(row)
        held += size
    if group:
        yield group


def _tokens(parts: list[tuple[bytes, bytes]]) -> int:
    """At most so many tokens."""
    return sum(len(a) + len(b) for a, b in parts) // 2


def _encoded(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(id, a, b): the ids of each part of a text, as unsigned integers (`Encoder.kind`); no parts without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(*paths)
        for batch in small_batches(batches, 1 << 20):
            parts = list(own.rows(batch.column(1).to_pylist()))
            sides = [pa.array([[part[side] for part in row] for row in parts], pa.list_(pa.binary())) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sides], names=["id", "a", "b"])

    id_ddl = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {id_ddl}, a array<binary>, b array<binary>")


def _parts_of(batch: pa.RecordBatch) -> list[list[tuple[bytes, bytes]]]:
    return [list(zip(a, b, strict=True)) for a, b in zip(*(batch.column(name).to_pylist() for name in ("a", "b")), strict=True)]


def _pairs_of_tasks(encoded: DataFrame, sizes: Sizes) -> DataFrame:
    """(task, pair, n): how many of a task's documents hold a pair. A task of very many pairs may tell one in parts."""
    shift = (len(sizes.a) * len(sizes.b)).bit_length()

    def distinct(rows: list) -> np.ndarray:
        """The distinct pairs of each document, one document after the other."""
        if len(rows) == 1:  # it may be long
            parts = [np.unique(Aligned(group, sizes).pairs) for group in _grouped(rows[0], lambda part: _tokens([part]))]
            return np.unique(np.concatenate(parts))
        found = Aligned([part for row in rows for part in row], sizes)
        doc = np.repeat(np.arange(len(rows)), [len(row) for row in rows])[found.part]
        return np.unique(doc << shift | found.pairs) & (1 << shift) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("encoder")
        task = TaskContext.get().partitionId()
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([pairs, *waiting])
            weights = np.concatenate([counts, np.ones(len(every) - len(pairs), np.int64)])
            waiting.clear()
            values, place = np.unique(every, return_inverse=True)
            return values, np.bincount(place, weights, len(values)).astype(np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), task)), pa.array(pairs), pa.array(counts)], names=["task", "pair", "n"])

        for batch in small_batches(batches, 4 << 20):
            for rows in _grouped([row for row in _parts_of(batch) if row], _tokens):
                waiting.append(distinct(rows))
                if sum(map(len, waiting)) >= TASK_PAIRS:
                    pairs, counts = merged()
                    if len(pairs) >= TASK_PAIRS:
                        yield out()
                        pairs, counts = pairs[:0], counts[:0]
        pairs, counts = merged()
        if len(pairs):
            yield out()

    return encoded.select("a", "b").mapInArrow(run, "task long, pair long, n long")


class PairCounts:
    """Counts of the pairs of some slices by their perfect hash, with the keys that prove an index."""

    def __init__(self, n_slices: int, rows: list, best: np.ndarray):
        parts = {row.slice: (np.array(row.sizes, np.int64), np.frombuffer(row.words, "<u8")) for row in rows}
        self.hash = perfect_hash.PerfectHash(n_slices, parts)
        self.keys = np.concatenate([np.zeros(0, "<i8"), *(np.frombuffer(row.keys, "<i8") for row in rows)])
        self.counts = np.concatenate([np.zeros(0, "<i8"), *(np.frombuffer(row.counts, "<i8") for row in rows)])
        self.best = best

    def look_up(self, pairs: np.ndarray) -> np.ndarray:
        """The count of each pair; 0 for one of another slice, which has no key of its own at its index."""
        counts = np.zeros(len(pairs), np.int64)
        at = self.hash.index(pairs)
        own = np.flatnonzero(at >= 0)
        own = own[self.keys[at[own]] == pairs[own]]
        counts[own] = self.counts[at[own]]
        return counts

    def of_links(self, found: Aligned) -> tuple[list[int], list[int]]:
        """For each part: links whose count is the highest of their A id, and the sum of the counts."""
        pairs, place = np.unique(found.pairs, return_inverse=True)
        counts = self.look_up(pairs)[place]
        return found.by_part((counts > 0) & (counts == self.best[found.link_a])), found.by_part(counts)


def _build_slice(key: tuple, table: pa.Table) -> pa.Table:
    pairs = table["pair"].to_numpy()
    sizes, words = perfect_hash.build(pairs)
    keys = np.empty_like(pairs)
    keys[perfect_hash.PerfectHash(1, {0: (sizes, words)}).index(pairs)] = pairs
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64())), "words": [words.tobytes()], "keys": [keys.tobytes()]})


VECTOR = pa.schema([("slice", pa.int64()), ("branch", pa.int64()), ("counts", pa.binary())])


def _dense(key: tuple, counts: pa.Table, functions: pa.Table) -> pa.Table:
    """The counts of some tasks as one vector, indexed by the hash of a slice."""
    if not counts.num_rows:
        return VECTOR.empty_table()
    sizes, words = np.array(functions["sizes"][0].as_py(), np.int64), np.frombuffer(functions["words"][0].as_py(), "<u8")
    at = perfect_hash.PerfectHash(1, {0: (sizes, words)}).index(counts["pair"].to_numpy())
    vector = np.zeros(int(np.bitwise_count(words).sum()), np.int64)
    np.add.at(vector, at, counts["n"].to_numpy())
    return pa.Table.from_arrays([pa.array([part.as_py()]) for part in key] + [pa.array([vector.tobytes()], pa.binary())], schema=VECTOR)


def _added(key: tuple, vectors: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(vector.as_py(), "<i8") for vector in vectors["counts"])
    return pa.Table.from_arrays([pa.array([part.as_py()]) for part in key] + [pa.array([total.tobytes()], pa.binary())], schema=VECTOR)


def pair_table(encoded: DataFrame, sizes: Sizes, slice_keys: int, fan: int) -> tuple[DataFrame, int]:
    """(slice, sizes, words, keys, counts) for each slice of the distinct pairs, stored; and the number of slices.

    The counts of `fan` tasks meet in one dense vector, `fan` vectors in one sum, and so on, so a task never takes in
    more than that of a slice, whatever the number of documents.
    """
    told = stored(_pairs_of_tasks(encoded, sizes), "pairs-told")
    distinct = stored(told.select("pair").distinct(), "pairs")
    slices = perfect_hash.slice_count(distinct.count(), slice_keys)
    sliced = (F.col("pair") % slices).alias("slice")
    functions = stored(
        distinct.select("pair", sliced).groupBy("slice").applyInArrow(_build_slice, "slice long, sizes array<long>, words binary, keys binary"),
        "pair-functions",
    )
    n_tasks = told.agg(F.max("task")).first()[0]
    branches = 1 + (n_tasks or 0) // fan
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(branches - 1).cast("long"))
    every = functions.select("slice", "sizes", "words", F.explode(numbers).alias("branch"))
    parts = told.select("pair", "n", sliced, F.floor(F.col("task") / fan).alias("branch"))
    vector = "slice long, branch long, counts binary"
    vectors = parts.groupBy("slice", "branch").cogroup(every.groupBy("slice", "branch")).applyInArrow(_dense, vector)
    while branches > 1:
        branches = 1 + (branches - 1) // fan
        vectors = vectors.withColumn("branch", F.floor(F.col("branch") / fan)).groupBy("slice", "branch").applyInArrow(_added, vector)
    return stored(functions.join(vectors.drop("branch"), "slice"), "pair-counts"), slices


def _best(table: DataFrame, sizes: Sizes) -> np.ndarray:
    """The highest count of each A id; no more rows than A has ids reach the driver."""
    size_a, size_b = len(sizes.a), len(sizes.b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(size_a, np.int64)
        for batch in batches:
            for keys, counts in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                np.maximum.at(best, np.frombuffer(keys, "<i8") // size_b, np.frombuffer(counts, "<i8"))
        held = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(best[held])], names=["a", "best"])

    rows = table.select("keys", "counts").mapInArrow(run, "a long, best long").groupBy("a").agg(F.max("best").alias("best"))
    best = np.zeros(size_a, np.int64)
    for row in rows.collect():
        best[row.a] = row.best
    return best


def _described(encoded: DataFrame, sizes: Sizes, counts: PairCounts) -> DataFrame:
    known = encoded.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("encoder")
        written = Written(sizes)
        for batch in small_batches(batches, 4 << 20):
            rows = _parts_of(batch)
            numbers = np.zeros((len(rows), len(COLUMNS)), np.int64)
            digests = [hashlib.sha256() if row else None for row in rows]
            ended = [b""] * len(rows)  # the last semicolon of what came before
            numbered = [(doc, part) for doc, row in enumerate(rows) for part in row]
            for group in _grouped(numbered, lambda x: _tokens([x[1]])):
                docs = [doc for doc, _ in group]
                found = Aligned([part for _, part in group], sizes)
                n_groups = np.diff(np.searchsorted(found.groups, [0, *found.part_ends.tolist()], side="right"))
                sums = [found.counts_a, found.counts_b, n_groups, found.by_part(np.ones(len(found.pairs), np.int64)), *known.value.of_links(found)]
                np.add.at(numbers, docs, np.array(sums, np.int64).T)
                for doc, text in zip(docs, found.texts(written), strict=True):
                    digests[doc].update(ended[doc])
                    digests[doc].update(text[:-1])
                    ended[doc] = b";"
            hashes = [digest.hexdigest() if digest else "" for digest in digests]
            arrays = [batch.column("id"), *(pa.array(column) for column in numbers.T), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", *COLUMNS, "groups_sha256"])

    id_ddl = encoded.schema["id"].dataType.simpleString()
    return encoded.mapInArrow(run, f"id {id_ddl}, {', '.join(f'{c} long' for c in COLUMNS)}, groups_sha256 string")


def align_tokens(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    slice_keys: int = perfect_hash.SLICE_KEYS,
    lookup_pairs: int = LOOKUP_PAIRS,
    fan: int = FAN,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of `docs`.

    Texts are cut into units that neither tokenizer reaches across, so each distinct unit is encoded once by a task; the
    ids are stored. A first pass aligns them and gathers the distinct pairs of linked ids with their counts by task. The
    pairs get a minimal perfect hash, slice by slice; counts are dense vectors in its order, summed as a tree. A second
    pass aligns again and looks each link up, proven by the key at its index. A task holds at most `lookup_pairs` pairs at
    once, 20 bytes each; where there are more, that many slices at a time are looked up in a pass of their own, and
    the sums are added by row.

    Null and empty texts, and those with bytes that a tokenizer does not give back (B writes U+2581 as a space), have no
    tokens: zeros and ''. Rows that repeat, or have no id, count and are counted like others; further columns are left
    out. No rows give no rows.
    """
    paths = (path_a, path_b)
    sizes = byte_sizes(Encoder(*paths))
    encoded = stored(_encoded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), paths), "token-ids")
    table, slices = pair_table(encoded, sizes, slice_keys, fan)
    best = _best(table, sizes)
    at_once = max(1, lookup_pairs // slice_keys)
    passes = []
    for first in range(0, slices, at_once):
        own = table.filter(F.col("slice").between(first, first + at_once - 1)).orderBy("slice").collect()
        passes.append(_described(encoded, sizes, PairCounts(slices, own, best)))
    result = passes[0]
    if len(passes) > 1:
        for more in passes[1:]:
            result = result.union(more)
        same = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]  # rows alike in all of these have the same links
        result = result.groupBy(*same).agg(*[F.sum(c).alias(c) for c in ("n_best", "count_sum")], F.count("*").alias("rows"))
        times = F.expr(f"rows div {len(passes)}")
        result = result.withColumn("times", times).select(
            *same, F.expr("n_best div times").alias("n_best"), F.expr("count_sum div times").alias("count_sum"), F.explode(F.sequence(F.lit(1), "times"))
        )
    return result.select(F.col("id").alias(id_col), *COLUMNS, "groups_sha256")
