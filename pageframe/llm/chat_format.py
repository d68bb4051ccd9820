"""Chat formatting: quoted passages are linked to the messages they come from, and left out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageframe.llm.ordered import largest_before, sums_before
from pageframe.llm.texts import small_batches, stored

QUOTE = re.compile(r"[ \t]*(?:>[ \t]?)+")
SPACE = re.compile(r"\s+")


def levels(text: str) -> list[tuple[int, str]]:
    """(level, line without marks) of every line; the level is the number of > marks that lead it."""
    out = []
    for line in text.split("\n"):
        marks = QUOTE.match(line)
        lead = marks.group() if marks else ""
        out.append((lead.count(">"), line[len(lead) :]))
    return out


def passages(lines: list[tuple[int, str]]) -> list[tuple[int, list[str]]]:
    """Runs of lines of one level, as (level, lines)."""
    out: list[tuple[int, list[str]]] = []
    for level, line in lines:
        if out and out[-1][0] == level:
            out[-1][1].append(line)
        else:
            out.append((level, [line]))
    return out


def normalised(lines: list[str]) -> str:
    """Lower case, and white space and line breaks as one blank: mail programs break quoted lines anew."""
    return SPACE.sub(" ", " ".join(lines)).strip().lower()


def paragraphs(lines: list[str]) -> list[str]:
    """Normalised runs of lines between blank ones."""
    out: list[list[str]] = [[]]
    for line in lines:
        if line.strip():
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return [normalised(p) for p in out if p]


def pieces(lines: list[str]) -> list[tuple[int, str, int]]:
    """What a passage can be found by: (kind, hash, characters) of the whole, its paragraphs and its lines."""
    found = {}
    for kind, texts in enumerate([[normalised(lines)], paragraphs(lines), [normalised([line]) for line in lines]]):
        for text in texts:
            if text:
                found.setdefault(xxhash.xxh3_128_hexdigest(text), (kind, len(text)))
    return [(kind, digest, size) for digest, (kind, size) in found.items()]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    quote_type = pa.list_(pa.struct([("n", pa.int32()), ("level", pa.int32()), ("kind", pa.int32()), ("hash", pa.string()), ("size", pa.int32())]))
    for batch in small_batches(batches):
        clean, own, quoted, counts = [], [], [], []
        for text in batch.column("text").to_pylist():
            runs = passages(levels(text)) if text else []
            mine = [line for level, lines in runs if level == 0 for line in lines]
            clean.append("\n".join(mine).strip("\n"))
            found = {}
            for level, lines in runs:
                if level == 0:
                    for _, digest, _ in pieces(lines):
                        found[digest] = None
            for _, digest, _ in pieces(mine):
                found[digest] = None
            own.append(list(found))
            marked = [(level, lines) for level, lines in runs if level > 0 and normalised(lines)]
            counts.append(len(marked))
            quoted.append(
                [
                    {"n": n, "level": level, "kind": kind, "hash": digest, "size": size}
                    for n, (level, lines) in enumerate(marked)
                    for kind, digest, size in pieces(lines)
                ]
            )
        arrays = [
            batch.column("row"),
            pa.array(clean, pa.string()),
            pa.array(counts, pa.int32()),
            pa.array(own, pa.list_(pa.string())),
            pa.array(quoted, quote_type),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["row", "clean", "n_quotes", "own", "quoted"])


PARSED_DDL = (
    "row long, clean string, n_quotes int, own array<string>, "
    "quoted array<struct<n: int, level: int, kind: int, hash: string, size: int>>"
)


def link_quotes(parsed: DataFrame) -> DataFrame:
    """(row, reply_to, n_linked): the turn a message replies to, and how many of its quoted passages were found.

    `parsed` has (row, conv, turn, own, quoted). A passage is looked up in earlier turns of its conversation, as a
    whole, by paragraphs and by lines, and comes from the latest of them that holds it as its own words. Quotes and
    own pieces meet under (conversation, hash) in the order of turns, where each quote takes the latest own piece
    before it; no pair of rows is made, and a piece that every turn repeats is cut into slices. Of a message's
    passages the one of the lowest level, the most characters and the latest turn decides.
    """
    own = parsed.select("conv", F.explode("own").alias("hash"), "turn", F.lit(1).alias("side"), F.lit(None).cast("long").alias("row"), F.lit(None).cast(parsed.schema["quoted"].dataType.elementType).alias("q")).distinct()
    quotes = parsed.select("conv", F.explode("quoted").alias("q"), "turn", "row").select(
        "conv", F.col("q.hash").alias("hash"), "turn", F.lit(0).alias("side"), "row", "q"
    )
    known = own.join(quotes.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    both = known.unionByName(quotes).filter("conv is not null and turn is not null")
    found = (
        largest_before(both, ["conv", "hash"], ["turn", "side"], F.when(F.col("side") == 1, F.col("turn")), "origin")
        .filter("side = 0 and origin is not null")
        .select("row", "q", "origin")
    )
    return (
        found.groupBy("row")
        .agg(
            F.max_by("origin", F.struct(-F.col("q.level"), "q.size", "origin")).alias("reply_to"),
            F.count_distinct("q.n").alias("n_linked"),
        )
    )


def threads(replies: DataFrame) -> DataFrame:
    """(conv, turn, thread): the first turn of the chain of replies that each replying turn hangs on, by doubling."""
    up = stored(replies.select("conv", "turn", F.col("reply_to").alias("thread")), "chat-threads")
    while True:
        further = up.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("root"))
        joined = up.join(further, ["conv", "thread"], "left")
        up = stored(joined.select("conv", "turn", F.coalesce("root", "thread").alias("thread"), F.col("root").isNotNull().alias("moved")), "chat-threads")
        if not up.filter("moved").take(1):
            return up.select("conv", "turn", "thread")


def chat_format(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv, turn, role, reply_to, thread, position, n_quotes, n_linked, message) for every message.

    `reply_to` is the turn whose words a message quotes, null where it quotes nothing that an earlier turn says.
    `thread` is the first turn of its chain of replies, or its own. In reply order, by (thread, turn), an answer stands
    below the thread it answers, never before what it replies to; `position` counts from 0 in that order. `message` is
    the text without quoted lines under its role: "<|role|>\\ntext\\n<|end|>".

    A null role is "unknown", a null text is empty. Messages without conversation or turn quote nothing and are not
    quoted; they are ordered first. Where a turn is there twice both rows quote, and are quoted, alike; they are
    ordered by role and text. No rows give no rows.
    """
    rows = stored(
        messages.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(conv_col).alias("conv"),
            F.col(turn_col).cast("long").alias("turn"),
            F.col(role_col).alias("role"),
            F.col(text_col).alias("text"),
        ),
        "chat-rows",
    )
    parsed = stored(
        rows.select("row", "conv", "turn", "role").join(rows.select("row", "text").mapInArrow(_parse, PARSED_DDL), "row"), "chat-parsed"
    )
    linked = stored(link_quotes(parsed), "chat-links")
    replies = parsed.join(linked, "row").groupBy("conv", "turn").agg(F.min("reply_to").alias("reply_to"))
    roots = threads(replies)
    placed = (
        parsed.select("row", "conv", "turn", "role", "clean", "n_quotes")
        .join(linked, "row", "left")
        .join(roots, ["conv", "turn"], "left")
        .withColumn("thread", F.coalesce("thread", "turn"))
        .withColumns({"digest": F.xxhash64("clean"), "one": F.lit(1).cast("long"), "no_conv": F.col("conv").isNull()})
    )
    key = F.coalesce(F.col("conv").cast("string"), F.lit(""))
    ordered = sums_before(
        placed.withColumn("conv_key", key), ["conv_key", "no_conv"], ["thread", "turn", "role", "digest", "row"], {"position": "one"}
    )
    role = F.coalesce("role", F.lit("unknown"))
    return ordered.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        "reply_to",
        "thread",
        "position",
        F.col("n_quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.concat(F.lit("<|"), role, F.lit("|>\n"), "clean", F.lit("\n<|end|>")).alias("message"),
    )
