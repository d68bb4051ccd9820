"""Ranked lexical search, a term at a time with limited accumulators, over blocks of documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageframe.llm.texts import small_batches, stored

TOP = 10
#: Bytes of item texts that are asked at once; their terms are what a task holds besides its block of documents.
ITEM_BYTES = 4 << 20
#: Letters and digits, A-Z lower-cased, and all bytes beyond ASCII stay; the rest becomes a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order: bytes.split() cuts at ASCII white space alone."""
    return text.encode().translate(TERM_BYTES).split() if text else []


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norms(n_terms: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """10 + (90 * n * N) div L; in Python's integers, as the product may leave 64 bits."""
    values, place = np.unique(n_terms, return_inverse=True)
    return np.array([10 + 90 * int(n) * n_docs // all_terms for n in values], np.int64)[place]


class Block:
    """Inverted lists of a block of documents: for each term its documents and what it is worth in them before weights."""

    def __init__(self, terms: np.ndarray, tfs: np.ndarray, docs: np.ndarray, norms: np.ndarray):
        order = np.argsort(terms, kind="stable")  # the documents of a term stay in order
        terms, tfs, self.docs = terms[order], tfs[order].astype(np.int64), docs[order]
        self.worth = 1_000_000_000 * tfs // (1000 * tfs + 8 * norms[self.docs])
        self.size = len(norms)
        known, starts = np.unique(terms, return_index=True)
        most = np.maximum.reduceat(self.worth, starts) if len(starts) else starts
        ends = [*starts[1:].tolist(), len(terms)]
        self.lists = dict(zip(known.tolist(), zip(starts.tolist(), ends, most.tolist(), strict=True), strict=True))

    def search(self, query: list[tuple[int, int]], k: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of all that may be among the k best, exactly; `least` is a score that k others reach.

        `query` holds (term, weight), rarest first. While what the remaining terms can add reaches the kth best partial
        score, a document that is met gets an accumulator. From then on no other one can come among the k best, not by a
        tie either, and only the documents that have an accumulator are looked up in the lists.
        """
        lists = [(weight, *self.lists[term]) for term, weight in query if term in self.lists]
        left = np.cumsum([0, *(weight * most for weight, _, _, most in reversed(lists))])[::-1].tolist()
        partial = np.zeros(self.size, np.int64)
        survivors = None
        kth = least
        for (weight, lo, hi, _), bound in zip(lists, left, strict=False):
            docs, worth = self.docs[lo:hi], self.worth[lo:hi]
            if survivors is None and bound < kth:
                survivors = np.flatnonzero(partial)
            if survivors is None:
                partial[docs] += weight * worth
                reached = partial[partial > 0]
                if len(reached) >= k:
                    kth = max(kth, int(np.partition(reached, -k)[-k]))
            elif len(survivors):
                at = np.minimum(np.searchsorted(docs, survivors), len(docs) - 1)
                held = docs[at] == survivors
                partial[survivors[held]] += weight * worth[at[held]]
            else:
                break
        found = np.flatnonzero(partial)
        return found, partial[found]


def _merge(best: list[tuple], found: list[tuple], k: int) -> list[tuple]:
    """The first k of (-score, id) with null ids last among equal scores."""
    return sorted(best + found, key=lambda row: (row[0], 1) if row[1] is None else (row[0], 0, row[1]))[:k]


def _postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) for each document: how many terms it has, and those of the vocabulary with their counts."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = known.value
        for batch in small_batches(batches):
            n, terms, tfs = [], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                counts = Counter(filter(numbers.__contains__, words))
                n.append(len(words))
                terms.append([numbers[word] for word in counts])
                tfs.append(list(counts.values()))
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "terms", "tfs"])

    id_ddl = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_ddl}, n long, terms array<int>, tfs array<long>")


def _frequencies(postings: DataFrame, n_terms: int) -> dict[int, int]:
    """Documents that hold a term; a task sends one number a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["term", "df"])

    counts = postings.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {row.term: row.df for row in counts.collect()}  # no more rows than terms of a block of items


def _block_results(docs: DataFrame, items: list[tuple], item_ddl: str, id_col: str, text_col: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    texts = [sorted(set(terms_of(text))) for _, text in items]
    vocabulary = {term: i for i, term in enumerate(sorted({term for terms in texts for term in terms}))}
    postings = stored(_postings(docs, vocabulary, id_col, text_col), "postings")
    n_docs, all_terms = postings.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = _frequencies(postings, len(vocabulary))
    queries = []
    for terms in texts:
        numbers = sorted((vocabulary[term] for term in terms if vocabulary[term] in df), key=lambda t: (df[t], t))
        queries.append([(t, term_weight(n_docs, df[t])) for t in numbers])
    asked = spark.sparkContext.broadcast(queries)
    id_type = postings.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in asked.value]
        arrow_type = None
        for batch in batches:
            arrow_type = batch.column(0).type
            if not batch.num_rows or not all_terms:
                continue
            lengths = pa.compute.list_value_length(batch.column(2)).to_numpy()
            block = Block(
                batch.column(2).flatten().to_numpy(),
                batch.column(3).flatten().to_numpy(),
                np.repeat(np.arange(batch.num_rows), lengths),
                length_norms(batch.column(1).to_numpy(), n_docs, all_terms),
            )
            for item, query in enumerate(asked.value):
                held = best[item]
                least = -held[-1][0] if len(held) == k else 0
                found, scores = block.search(query, k, least)
                if len(scores) > k:  # of the rest some may tie with the kth
                    some = scores >= np.partition(scores, -k)[-k]
                    found, scores = found[some], scores[some]
                if len(found):
                    ids = batch.column(0).take(pa.array(found)).to_pylist()
                    best[item] = _merge(held, list(zip((-scores).tolist(), ids, strict=True)), k)
        rows = [(item, doc, -score) for item, held in enumerate(best) for score, doc in held]
        if rows:
            numbers, ids, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int32()), pa.array(ids, arrow_type), pa.array(scores, pa.int64())],
                names=["item", "id", "score"],
            )

    scored = postings.mapInArrow(run, f"item int, id {id_type.simpleString()}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], f"item int, item_id {item_ddl}")
    return ranked.join(names, "item").select("item_id", "rank", F.col("id").alias(id_col), "score")


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """(item_id, rank, id, score): the k best documents of each row (item_id, text) of `items` with a score above 0.

    A document is one batch row: its terms are counted once, those that any item asks for are stored, and a task ranks
    its blocks of documents for one item after the other (`Block.search`), keeping k documents an item from block to
    block, so the bound on new accumulators rises while it reads. Frequencies and lengths are counted over all
    documents first. The k best of the tasks are ranked in a window that keeps k rows an item before it shuffles.

    Items are asked in blocks of `item_bytes` of text, each with a pass over the documents; only a block's terms and
    frequencies reach the driver. Equal scores are ranked by id, null ids last. Documents that are null or have no term
    are not counted and not found; rows that repeat are documents of their own, and so are repeated items. Items
    without terms, and empty tables, give no rows. Further columns are left out.
    """
    spark = docs.sparkSession
    item_ddl = items.schema["item_id"].dataType.simpleString()
    id_ddl = docs.schema[id_col].dataType.simpleString()
    result = spark.createDataFrame([], f"item_id {item_ddl}, rank int, `{id_col}` {id_ddl}, score long")
    block, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        size += len(row.text or "")
        if size >= item_bytes:
            result = result.unionByName(_block_results(docs, block, item_ddl, id_col, text_col, k))
            block, size = [], 0
    if block:
        result = result.unionByName(_block_results(docs, block, item_ddl, id_col, text_col, k))
    return result
