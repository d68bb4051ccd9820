"""Order-preserving packing of token streams by dynamic programming."""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageframe.llm.texts import small_batches
from pageframe.sources.readers import bounded_batches

WINDOW = 2048
END_ID = 1
#: What a cut costs, in tokens of padding: at the end of a sentence, and anywhere else in a document.
SENTENCE_PENALTY, INNER_PENALTY = 1, 8
#: Where a document offers no end of a sentence for so many tokens, it may be cut that often.
INNER_STEP = 16
#: Tokens of one dynamic program. The last window of one is the first of the next, so its size leaves no padding.
CHUNK = 1 << 20
#: Words of a generation; a Python worker keeps the ids of two of them.
CACHED_WORDS = 250_000
#: Letters before this one are letters in every version of Unicode.
LATIN_END = "\u0250"
SENTENCE_MARKS = (".", "!", "?", "...", "…", "。")
#: Marks that make tokens of their own behind a letter; an apostrophe may begin one with the letters that follow.
TAIL_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PIECE_DDL = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
)


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: printable ones stand for themselves, others follow 255."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = byte_letters()


class WordIds(dict):
    """Ids of a word as little-endian unsigned 32-bit integers, made when first asked for.

    When a generation of words is full the next begins; a word of the one before is carried over when it is met.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.model = tokenizer.model
        self.before: dict[bytes, bytes] = {}

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def merge(self, letters: str) -> bytes:
        """Ids of a word of Latin letters alone, which is one piece, so the merges can be asked directly."""
        return array("I", [piece.id for piece in self.model.tokenize(letters)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(word)
        if ids is None:
            if word.isalpha():  # ASCII letters, which are written as themselves
                ids = self.merge(word.decode())
            else:
                ids = self.mixed(word)
        self[word] = ids
        return ids

    def mixed(self, word: bytes) -> bytes:
        """Ids of a word that is not of ASCII letters alone."""
        head = word.rstrip(TAIL_MARKS)
        text = head.decode()
        # After a letter the marks are a token run of their own, so the word before them can be looked up alone.
        if head and len(head) < len(word) and text[-1].isalpha() and text[-1] < LATIN_END:
            return self[head] + self[word[len(head) :]]
        if len(head) == len(word) and text.isalpha() and max(text) < LATIN_END:
            return self.merge(word.decode("latin-1").translate(BYTE_LETTERS))
        return self.encode(word.decode())

    def forget(self) -> None:
        """Drops all words, so that an idle worker holds none."""
        self.clear()
        self.before = {}

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a whole text, the same as the tokenizer's own.

        Tokens never reach across white space and letters are lower-cased, so ids can be looked up by the word. Where
        that could differ (special tokens, decomposed letters, a sigma, whose lower case depends on its place), the
        tokenizer gets the text as it is.
        """
        if not text:
            return np.zeros(0, "<u4")
        if "<|" in text or "Σ" in text or not is_normalized("NFC", text):
            return np.frombuffer(self.encode(text), "<u4")
        return np.frombuffer(b"".join(map(self.__getitem__, text.lower().encode().split())), "<u4")


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's table for a tokenizer file; a worker keeps the tokenizer from task to task, the words for one task."""
    if path not in _WORD_IDS:
        from tokenizers import Tokenizer

        _WORD_IDS[path] = WordIds(Tokenizer.from_file(path))
    return _WORD_IDS[path]


def choose_cuts(
    points: list[int], costs: list[int], window: int = WINDOW, tail: Callable[[int], int] | None = None
) -> list[int]:
    """The cheapest way from the first point to the last in steps of at most `window`, as indexes of points.

    A step costs its padding, `window` minus its length, and the cost of the point where it ends. So far a path to i
    costs g[i] - points[i] with g[j] = min(g[i]) + window + costs[j] over the points i within reach; a queue of
    points with growing g gives that minimum in constant time. Neighbouring points are at most `window` apart. Of
    equally cheap steps the longest is taken. With `tail` the last step costs that of its length.
    """
    n = len(points)
    g, back = [0] * n, [0] * n
    queue, head = [0], 0
    for j in range(1, n):
        reach = points[j] - window
        while points[queue[head]] < reach:
            head += 1
        i = queue[head]
        back[j] = i
        g[j] = best = g[i] + window + costs[j]
        while len(queue) > head and g[queue[-1]] > best:
            queue.pop()
        queue.append(j)
    if tail is not None and n > 1:
        ends = range(bisect_left(points, points[-1] - window), n - 1)
        back[n - 1] = min(ends, key=lambda i: g[i] - points[i] + tail(points[-1] - points[i]))
    path, j = [n - 1], n - 1
    while j > 0:
        j = back[j]
        path.append(j)
    return path[::-1]


def candidates(
    bounds: np.ndarray, sentences: np.ndarray, window: int = WINDOW, inner_step: int = INNER_STEP
) -> tuple[list[int], list[int]]:
    """Points where the stream may be cut and their costs; `bounds` are the ends of documents, from 0 on.

    Multiples of the window are among them, so a way without padding is always one of those compared.
    """
    size = int(bounds[-1]) + 1
    costs = np.zeros(size, np.int8)  # of every place between two ids; 0 where the stream is not cut
    costs[::window] = INNER_PENALTY
    costs[sentences] = SENTENCE_PENALTY
    is_bound = np.zeros(size, bool)
    is_bound[bounds] = True
    known = np.flatnonzero((costs > 0) | is_bound)
    # Points of their own inside wide gaps, at every `inner_step` behind a known one.
    inner = (np.diff(known) - 1) // inner_step
    nth = np.arange(1, inner.sum() + 1) - np.repeat(np.cumsum(inner) - inner, inner)
    extra = np.repeat(known[:-1], inner) + nth * inner_step
    costs[extra] = INNER_PENALTY
    costs[bounds] = 0
    points = np.flatnonzero((costs > 0) | is_bound)
    costs = costs[points]
    return points.tolist(), costs.tolist()


def powers(length: int, window: int = WINDOW) -> list[int]:
    """How the last window of a stream is cut: into powers of two, which need no padding, where that is cheaper."""
    parts = [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]
    return parts if (len(parts) - 1) * INNER_PENALTY < window - length else [length]


def tail_cost(length: int, window: int = WINDOW) -> int:
    parts = powers(length, window)
    return window - length if parts == [length] and length & (length - 1) else (len(parts) - 1) * INNER_PENALTY


class Packer:
    """Packs one ordered stream of documents; holds a chunk of it and emits finished sequences."""

    def __init__(self, stream: int, window: int = WINDOW, mark_ids: np.ndarray | None = None):
        self.window = window
        self.marks = np.zeros(0, "<u4") if mark_ids is None else mark_ids
        self.next_sequence = stream << 40
        self.docs: list[tuple[object, np.ndarray, int, int]] = []  # key, ids, ids before them, ids of the document
        self.held = 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((key, ids, 0, len(ids)))
        self.held += len(ids)
        if self.held >= CHUNK:
            yield from self.flush(last=False)

    def flush(self, last: bool) -> Iterator[tuple]:
        """(key, start, length, crc32, doc_tokens, sequence_id, offset, ids) of every piece of the finished windows."""
        if not self.docs:
            return
        docs = self.docs
        flat = np.concatenate([ids for _, ids, _, _ in docs])
        bounds = np.cumsum([0, *(len(ids) for _, ids, _, _ in docs)])
        points, costs = candidates(bounds, np.flatnonzero(np.isin(flat, self.marks)) + 1, self.window)
        tail = (lambda length: tail_cost(length, self.window)) if last else None
        cuts = [points[i] for i in choose_cuts(points, costs, self.window, tail)]
        if last:
            cuts[-1:] = (cuts[-2] + np.cumsum(powers(cuts[-1] - cuts[-2], self.window))).tolist()
        else:
            cuts.pop()
        limit = cuts[-1]
        edges = np.unique(np.concatenate([bounds[bounds <= limit], cuts])).tolist()
        owner = np.searchsorted(bounds, edges[:-1], side="right") - 1
        window_of = np.searchsorted(cuts, edges[:-1], side="right") - 1
        for lo, hi, d, w in zip(edges[:-1], edges[1:], owner.tolist(), window_of.tolist(), strict=True):
            key, _, before, total = docs[d]
            ids = flat[lo:hi]
            start = before + lo - int(bounds[d])
            yield key, start, hi - lo, zlib.crc32(ids.tobytes()), total, self.next_sequence + w, lo - cuts[w], ids
        self.next_sequence += len(cuts) - 1
        first = int(np.searchsorted(bounds, limit, side="right")) - 1
        self.docs = [
            (key, ids[cut:], before + cut, total)
            for (key, ids, before, total), at in zip(docs[first:], bounds[first:-1].tolist(), strict=True)
            for cut in [max(0, limit - at)]
            if cut < len(ids)
        ]
        self.held = len(flat) - limit


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    with_ids: bool = True,
) -> DataFrame:
    """A row for every piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    A document is the ids of its whole text and a last id 1; a null or empty text is that id alone. The documents of
    an input partition, in its order, are one stream. It is cut into sequences of at most `window` ids at the ends of
    documents and sentences, so that padding plus penalties for cutting documents is smallest; the text is never
    shuffled. Only the last window of a stream can be far from full, and it is cut into powers of two, which need no
    padding. Rows that repeat, or that have no id, are packed like others. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(tokenizer_path)
        marks = [np.frombuffer(table.encode(mark), "<u4") for mark in SENTENCE_MARKS]
        marks = np.unique(np.concatenate([m for m in marks if len(m) == 1]))
        packer = Packer(TaskContext.get().partitionId(), window, marks)
        end = np.array([END_ID], "<u4")
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        id_type = pa.int64()
        for batch in small_batches(batches):
            id_type = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in packer.add(key, np.concatenate([table.ids(text.as_py()), end])):
                    rows.append(piece)
                if len(rows) >= 2000:
                    yield out()
        table.forget()
        rows.extend(packer.flush(last=True))
        if rows:
            yield out()

    id_ddl = docs.schema[id_col].dataType.simpleString()
    ddl = f"id {id_ddl}, {PIECE_DDL}" if with_ids else f"id {id_ddl}, {PIECE_DDL.rpartition(', ')[0]}"
    names = [part.split()[0] for part in ddl.split(", ")]
    pieces = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)
    return pieces.withColumnRenamed("id", id_col)
