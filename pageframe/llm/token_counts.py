"""Token counts of whole texts; huge ones are encoded in overlapping chunks and spliced where both agree for good."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.llm.packing import BYTE_LETTERS
from pageframe.llm.texts import small_batches, stored
from pageframe.llm.units import Remembered, per_worker, split_units

#: A text of more bytes is cut into chunks of so many, each reaching over the next one by the overlap.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Texts with two chunks that do not align get chunks and overlaps so many times as long.
WIDER = 8
#: Bytes at either end of an overlap that prove nothing: the longest look-ahead of a pre-token is three characters.
MARGIN = 16
TOKENS = 1024


class TokenCounter:
    """Counts of one tokenizer file, with special strings inside texts taken as the library does by default."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [token.content for token in added.values()]
        self.margin = max([MARGIN, *(len(content.encode()) for content in self.special)])
        lengths = {i: len(token) for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        lengths |= {i: len(token.content.encode()) for i, token in added.items()}
        self.lengths = np.zeros(max(lengths) + 1, np.int64)
        self.lengths[list(lengths)] = list(lengths.values())
        self.spaced = Remembered(lambda unit: self._unit(" " + unit))

    def _unit(self, text: str) -> int:
        body = text[1:]
        # After an ASCII letter a last mark is a token of its own, and Latin letters alone are one pre-token.
        if len(body) > 1 and body[-1] in ".," and "a" <= body[-2].lower() <= "z":
            return self.spaced[body[:-1]] + 1
        if body.isascii() and body.isalpha():
            return len(self.tokenizer.model.tokenize(BYTE_LETTERS[32] + body))
        return self.encoded(text)

    def encoded(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(content in text for content in self.special):
            return self.encoded(text)
        first, *units = split_units(text)
        return self.encoded(first) + sum(map(self.spaced.__getitem__, units))

    def boundaries(self, piece: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of tokens; the inner ends of pre-tokens, in bytes; and the tokens before each."""
        encoding = self.tokenizer.encode(piece.decode(), add_special_tokens=False)
        words = np.array(encoding.word_ids, np.int64)
        ends = np.flatnonzero(np.diff(words)) + 1
        return len(words), np.cumsum(self.lengths[encoding.ids])[ends - 1], ends


def token_counter(path: str) -> TokenCounter:
    return per_worker(("token counter", path), lambda: TokenCounter(path))


def chunk_starts(data: bytes, chunk: int, overlap: int) -> list[int]:
    """Where chunks begin, at whole characters; the last one is longer than the overlap."""
    starts = [0]
    while len(data) - starts[-1] > chunk + overlap:
        starts.append(_whole(data, starts[-1] + chunk))
    return starts


def _whole(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def spliced(texts: DataFrame, tokenizer_path: str, chunk: int, overlap: int) -> DataFrame:
    """(sha, n_tokens) for each distinct text of (sha, text); null where two neighbouring chunks have no common boundary.

    Pre-tokens are found from left to right, each from the text behind its start. So once a chunk and the next one
    both end a pre-token at a byte, all that follows is the same, if the text that decides is in sight: a place nearer to
    an end of the overlap than a look-ahead or a special string is not taken. The tokens before the place are then the
    earlier chunk's, those behind it the later one's. A row is a chunk, so a text is spread over the tasks.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for sha, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py().encode()
                starts = chunk_starts(data, chunk, overlap)
                for no, (at, to) in enumerate(zip(starts, [*starts[1:], len(data)], strict=True)):
                    piece = data[at : _whole(data, min(len(data), to + overlap))]
                    columns = [[sha], [no], [at], [to], [no == len(starts) - 1], [piece]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            for sha, no, at, to, last, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, ends, before = counter.boundaries(piece)
                ends = ends + at
                head = (ends >= at + counter.margin) & (ends <= at + overlap - counter.margin) & (no > 0)
                rows.append((sha, no, n, ends[head].tolist(), before[head].tolist(), None, None))
                if not last:
                    tail = (ends >= to + counter.margin) & (ends <= at + len(piece) - counter.margin)
                    rows.append((sha, no + 1, 0, None, None, ends[tail].tolist(), (n - before[tail]).tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out
                )

    longs = pa.list_(pa.int64())
    schema = pa.schema([("sha", pa.string()), ("no", pa.int64()), ("at", pa.int64()), ("to", pa.int64()), ("last", pa.bool_()), ("piece", pa.binary())])
    out = pa.schema([("sha", pa.string()), ("cut", pa.int64()), ("n", pa.int64()), ("head", longs), ("before", longs), ("tail", longs), ("behind", longs)])
    pieces = texts.select("sha", "text").mapInArrow(cut, "sha string, no long, at long, to long, last boolean, piece binary")
    pieces = pieces.dropDuplicates(["sha", "no"])  # a text that repeats is encoded once; this deals the chunks out, too
    ends = pieces.mapInArrow(
        encode,
        "sha string, cut long, n long, head array<long>, before array<long>, tail array<long>, behind array<long>",
    )
    one = {name: F.first(name, ignorenulls=True).alias(name) for name in ("head", "before", "tail", "behind")}
    cuts = ends.groupBy("sha", "cut").agg(F.sum("n").alias("n"), *one.values())
    place = F.array_min(F.array_intersect("head", "tail"))

    def tokens(side: str, counts: str) -> Column:
        return F.element_at(counts, F.array_position(side, place).cast("int"))

    # What both chunks count: the earlier one's tokens behind the place, the later one's before it.
    twice = F.when(F.col("tail").isNull(), 0).when(place.isNotNull(), tokens("tail", "behind") + tokens("head", "before"))
    cuts = cuts.select("sha", "n", twice.alias("twice"))
    whole = F.when(F.bool_and(F.col("twice").isNotNull()), F.sum("n") - F.sum("twice"))
    return cuts.groupBy("sha").agg(whole.alias("n_tokens"))


def huge_counts(
    texts: DataFrame, tokenizer_path: str, chunk: int = CHUNK, overlap: int = OVERLAP, wider: int = WIDER
) -> DataFrame:
    """(sha, n_tokens) for each distinct text of (sha, text). Chunks that fail to align are made anew, longer, until all do.

    A chunk as long as its text always does, so the rounds end: five of them reach the longest text a row can hold.
    """
    done, open_texts = [], texts
    while True:
        counts = stored(spliced(open_texts, tokenizer_path, chunk, overlap), "token-counts")
        done.append(counts.filter("n_tokens is not null"))
        failed = counts.filter("n_tokens is null").select("sha")
        if failed.isEmpty():
            break
        open_texts = texts.join(failed, "sha", "left_semi")
        chunk, overlap = chunk * wider, overlap * wider
    result = done[0]
    for counts in done[1:]:
        result = result.union(counts)
    return result


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """A row for each row of `docs`: (id, n_bytes, n_tokens, over_limit), as the tokenizer counts the whole text.

    No special tokens are added; their strings inside a text count as the library has it. Null and empty texts have no
    bytes and no tokens. Rows that repeat, or have no id, are counted like others; further columns are left out. A
    text of up to `chunk` bytes is counted where it lies, by units that are looked up; longer ones are chunks of their
    own (`spliced`), and no task encodes more of them than their overlaps ask for. No rows give no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer_path)
        for batch in small_batches(batches):
            n = [counter.count(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
    )
    id_ddl = rows.schema["id"].dataType.simpleString()
    short = rows.filter(F.col("n_bytes") <= chunk).mapInArrow(count, f"id {id_ddl}, n_bytes long, n_tokens long")
    huge = rows.filter(F.col("n_bytes") > chunk).withColumn("sha", F.sha2("text", 256))
    counts = huge_counts(huge.select("sha", "text"), tokenizer_path, chunk, overlap)
    huge = huge.select("id", "n_bytes", "sha").join(counts, "sha").select("id", "n_bytes", "n_tokens")
    return short.union(huge).select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
