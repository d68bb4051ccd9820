"""Mixing sources to target weights: exact quotas, split down a tree to shards, filled with disjoint permuted blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe.llm.ordered import sums_before
from pageframe.llm.texts import WORD, stored, whole_row, word_count

#: Words of a block, shards of the mix, and the seed of everything that is drawn.
BLOCK_WORDS, SHARDS, SEED = 256, 16, 20_240_201
#: numpy draws hypergeometrics of populations below a thousand million; larger ones are drawn by inversion.
NUMPY_DRAWS = 900_000_000
UNIT = ["id", "source", "digest", "size", "copy"]


def units(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """A row for every document, without its text: id, source, digest of the text, size in words, number of the copy.

    Rows that repeat in id, source and text are told apart by `copy`, from 1.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.xxhash64(F.col(text_col)).alias("digest"),
        word_count(F.col(text_col)).alias("size"),
    )
    counted = rows.groupBy("id", "source", "digest", "size").count()
    return counted.select("id", "source", "digest", "size", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"))


def targets(
    rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, total: int | None = None
) -> DataFrame:
    """(source, number, source_size, target): words that the mix wants of each source.

    Sources in the order of their code points, null last, weigh `weights`, repeating, and share `total` words (all
    there are, by default). A target stops at `max_repeats` times its source's size, and what is over is shared anew
    by weight until no target is above. A source without words gets 0.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums_before(
        sizes.select("source", "source_size", F.col("source").isNull().alias("last"), F.lit(0).alias("all"), F.lit(1).alias("one")),
        ["all"],
        ["last", "source"],
        {"number": "one"},
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    sources = stored(
        ranked.select("source", F.col("number").cast("long").alias("number"), "source_size", weight.alias("weight")), "mixing-sources"
    )
    cap = F.col("source_size") * max_repeats
    wanted = total if total is not None else sources.agg(F.sum("source_size")).first()[0] or 0
    share, stopped = 0.0, None
    while True:
        above = F.lit(share) * F.col("weight") > cap if stopped is not None else F.lit(False)
        row = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("kept"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weight"),
            F.count(F.when(above, 1)).alias("stopped"),
        ).first()
        if row["stopped"] == stopped:
            break
        stopped = row["stopped"]
        share = (wanted - row["kept"]) / row["weight"] if row["weight"] else share
    target = F.least(F.lit(share) * F.col("weight"), cap.cast("double"))
    return sources.select("source", "number", "source_size", target.alias("target"))


def drawn_key(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    low, high = max(0, draws - bad), min(good, draws)
    if low >= high:
        return low
    if good + bad <= NUMPY_DRAWS:
        return int(rng.hypergeometric(good, bad, draws))
    return _by_inversion(rng, good, bad, draws, low, high)


def _by_inversion(rng: np.random.Generator, good: int, bad: int, draws: int, low: int, high: int) -> int:
    """The same distribution at any size, from the ratios of neighbouring probabilities.

    Eight standard deviations around the mode are laid out, which leaves out less than a double can tell.
    """
    total = good + bad
    spread = (draws * (good / total) * (bad / total) * (total - draws) / (total - 1)) ** 0.5
    mode = (draws + 1) * (good + 1) // (total + 2)
    reach = int(8 * spread) + 64
    first, last = max(low, mode - reach), min(high, mode + reach)
    x = np.arange(first, last, dtype=np.float64)
    ratios = np.log((good - x) / (x + 1)) + np.log((draws - x) / (bad - draws + x + 1))
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def split_counts(counts: np.ndarray, seed: int, node: int) -> np.ndarray:
    """What the left child of a node gets of every source: half of all blocks, drawn without replacement."""
    rng = np.random.default_rng([seed, node])
    rest, draws, left = int(counts.sum()), int(counts.sum()) // 2, np.zeros_like(counts)
    for i, count in enumerate(counts.tolist()):
        rest -= count
        left[i] = _hypergeometric(rng, count, rest, draws)
        draws -= int(left[i])
    return left


def shard_quotas(counts: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(number, shard, quota): blocks of every source in every shard, down a tree of multivariate hypergeometrics.

    `counts` has (number, blocks). A node holds one count a source and nothing of the blocks. Every split depends on
    the seed and the node alone, so a lost task is split again in the same way; quotas add up exactly. The number of
    shards is a power of two.
    """
    levels = shards.bit_length() - 1
    root = counts.agg(F.sort_array(F.collect_list(F.struct("number", "blocks"))).alias("list")).select(
        F.lit(1).cast("long").alias("node"), F.col("list.number").alias("numbers"), F.col("list.blocks").alias("blocks")
    )

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for node, numbers, blocks in frame.itertuples(index=False):
                whole = np.array(blocks, np.int64)
                left = split_counts(whole, seed, node)
                yield pd.DataFrame({"node": [2 * node, 2 * node + 1], "numbers": [numbers] * 2, "blocks": [left, whole - left]})

    nodes = root
    for _ in range(levels):
        nodes = nodes.repartition("node").mapInPandas(split, "node long, numbers array<long>, blocks array<long>")
    return nodes.select(
        (F.col("node") - shards).cast("int").alias("shard"), F.explode(F.arrays_zip("numbers", "blocks")).alias("q")
    ).select(F.col("q.numbers").alias("number"), "shard", F.col("q.blocks").alias("quota"))


def draw(rows: DataFrame, goals: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix as blocks: (unit columns, epoch, block, words, shard, place).

    A source gives each of its blocks once for every whole time that its size goes into its target, and for the rest
    the first blocks of a random order, the last of them cut, so its words meet the rounded target exactly. The draws
    of a source, permuted, are dealt to the shards by quota, so no two shards hold the same draw; `place` is a random
    order inside a shard. Everything random is a hash of the document and the block, so reruns agree.
    """
    goal = goals.select(
        F.col("source").alias("goal_source"), "number", "source_size", F.floor(F.col("target") + 0.5).alias("words_wanted")
    )
    known = rows.filter("size > 0").join(goal, F.col("source").eqNullSafe(F.col("goal_source")))
    epochs = F.expr("words_wanted div source_size")
    last = F.floor((F.col("size") - 1) / block_words)
    blocks = known.select(
        *UNIT,
        "number",
        epochs.alias("epochs"),
        (F.col("words_wanted") - epochs * F.col("source_size")).alias("rest"),
        F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"),
    ).withColumns(
        {
            "length": F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words).cast("long"),
            "key": drawn_key(seed, "id", "digest", "block", "copy"),
        }
    )
    order = ["key", "id", "digest", "block", "copy"]
    placed = sums_before(blocks, ["number"], order, {"before": "length"})
    partial = F.greatest(F.lit(0), F.least("length", F.col("rest") - F.col("before")))
    draws = (
        placed.select(*UNIT, "number", "block", "length", "epochs", partial.alias("partial"), F.explode(F.sequence(F.lit(0).cast("long"), "epochs")).alias("epoch"))
        .withColumn("words", F.when(F.col("epoch") < F.col("epochs"), F.col("length")).otherwise(F.col("partial")))
        .filter("words > 0")
        .select(*UNIT, "number", "block", "epoch", "words", F.lit(1).cast("long").alias("one"))
        .withColumn("key", drawn_key(seed + 1, "id", "digest", "block", "copy", "epoch"))
    )
    permuted = stored(sums_before(draws, ["number"], [*order, "epoch"], {"rank": "one"}), "mixing-draws")
    quotas = shard_quotas(permuted.groupBy("number").agg(F.count("*").alias("blocks")), shards, seed)
    ends = (
        quotas.withColumn("end", F.sum("quota").over(Window.partitionBy("number").orderBy("shard")))
        .groupBy("number")
        .agg(F.sort_array(F.collect_list("end")).alias("ends"))  # one number a shard
    )
    return (
        permuted.join(ends, "number")
        .withColumn("shard", F.size(F.filter("ends", lambda end: end <= F.col("rank"))))
        .withColumn("place", drawn_key(seed + 2, "id", "digest", "block", "copy", "epoch"))
        .select(*UNIT, "epoch", "block", "words", "shard", "place")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = 3,
    **options,
) -> DataFrame:
    """(id, size, source_size, target, taken, n_shards) for every row of `docs`.

    Documents without words, null texts included, take part with size 0 and are taken 0 times. Rows without a source
    are a source of their own. Ids may be null or repeat. No rows give no rows.
    """
    rows = stored(units(docs, id_col, source_col, text_col), "mixing-units")
    goals = stored(targets(rows, weights, max_repeats), "mixing-targets")
    taken = (
        draw(rows, goals, **options)
        .groupBy(*UNIT)
        .agg(F.sum("words").alias("words"), F.count_distinct("shard").alias("n_shards"))
        .select(*[F.col(c).alias(f"t_{c}") for c in UNIT], "words", "n_shards")
    )
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in UNIT]
    goal = goals.select(F.col("source").alias("goal_source"), "source_size", "target")
    return (
        rows.join(taken, same, "left")
        .join(goal, F.col("source").eqNullSafe(F.col("goal_source")))
        .select(
            F.col("id").alias(id_col),
            "size",
            "source_size",
            "target",
            F.coalesce("words", F.lit(0)).cast("long").alias("taken"),
            F.coalesce("n_shards", F.lit(0)).cast("long").alias("n_shards"),
        )
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    length_col: str | None = "n_chars",
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = 3,
    block_words: int = BLOCK_WORDS,
    **options,
) -> DataFrame:
    """The mix as documents with the columns of `docs`: a row for each time a document is taken.

    Where all of its blocks are drawn the text is unchanged; else it is the drawn words, in order, joined by one
    space. `length_col` becomes the length of the new text. A document that is not taken has no row.
    """
    rows = stored(units(docs, id_col, source_col, text_col), "mixing-units")
    goals = stored(targets(rows, weights, max_repeats), "mixing-targets")
    draws = draw(rows, goals, block_words, **options)
    # One entry a time the document is taken: its drawn blocks. A document's blocks are bounded by its own text.
    times = draws.groupBy(*UNIT, "epoch").agg(
        F.sum("words").alias("words"), F.sort_array(F.collect_list(F.struct("block", "words"))).alias("blocks")
    )
    whole = F.col("words") == F.col("size")
    plan = (
        times.groupBy("id", "source", "digest")
        .agg(F.collect_list(F.struct(whole.alias("whole"), F.when(~whole, F.col("blocks")).alias("blocks"))).alias("m_times"))
        .select(F.col("id").alias("m_id"), F.col("source").alias("m_source"), F.col("digest").alias("m_digest"), "m_times")
    )
    own = docs.select(
        whole_row(docs).alias("doc"),
        F.col(id_col).alias("own_id"),
        F.col(source_col).alias("own_source"),
        F.xxhash64(F.col(text_col)).alias("own_digest"),
    ).dropDuplicates(["own_id", "own_source", "own_digest"])
    same = (
        F.col("own_id").eqNullSafe(F.col("m_id"))
        & F.col("own_source").eqNullSafe(F.col("m_source"))
        & (F.col("own_digest") == F.col("m_digest"))
    )
    taken = own.join(plan, same).select("doc", F.explode("m_times").alias("m_time"))
    text = F.col("doc").getField(text_col)
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))


    def drawn(all_words: Column) -> Column:
        def of(b: Column) -> Column:
            return F.slice(all_words, (b["block"] * block_words + 1).cast("int"), b["words"].cast("int"))

        return F.flatten(F.transform("m_time.blocks", of))

    part = F.array_join(F.flatten(F.transform(F.array(words), drawn)), " ")  # so a text is cut into words once
    taken = taken.select("doc", F.when(F.col("m_time.whole"), text).otherwise(part).alias("new_text"))
    new = {text_col: F.col("new_text")}
    if length_col is not None and length_col in docs.columns:
        new[length_col] = F.length("new_text").cast(docs.schema[length_col].dataType)
    return taken.select(*[new.get(name, F.col("doc").getField(name)).alias(name) for name in docs.columns])
