"""Exact dedup by content sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageframe.llm.texts import folded, small_batches, stored
from pageframe.sources.readers import bounded_batches

#: Characters of a text that a splitter holds. Beyond them its digest decides, so a sampled splitter stays small; the
#: order of rows is (these characters, digest, text, id), and comparisons see the whole text.
SPLITTER_CHARS = 64
INTERIOR, FIRST, LAST = 0, 1, 2


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Groups rows of equal text: (id, keep_id, group_size, kept, text_sha256), a row for every input row.

    Texts are equal when they are the same after lower-casing A-Z; null counts as empty. Sampled splitters deal the
    rows out by range and an external sort puts equal texts side by side, where each text is compared with its
    neighbour in full. The id is part of the range, so a text that fills a third of the table spreads over many
    slices. A run of equal texts inside a slice is complete; the first and the last run of a slice, two rows a slice,
    are matched with those of other slices by their whole text. Of a group stays the row with the smallest (or
    `keep="largest"`) id, one row even where rows repeat; rows without id come last. No rows give no rows.
    """
    id_type = docs.schema[id_col].dataType
    by_id = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), folded(F.col(text_col)).alias("norm")).withColumn(
        "sha", F.sha2("norm", 256)
    )
    lead = F.substring("norm", 1, SPLITTER_CHARS)
    placed = rows.repartitionByRange(lead, "sha", by_id).sortWithinPartitions(lead, "sha", "norm", by_id)
    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("sha", T.StringType()),
            T.StructField("slice", T.IntegerType()),
            T.StructField("edge", T.IntegerType()),
            T.StructField("head", T.BooleanType()),
            T.StructField("keep", id_type),
            T.StructField("size", T.LongType()),
            T.StructField("edge_text", T.StringType()),
        ]
    )
    marked = stored(placed.mapInArrow(_mark_runs, schema), "exact-runs")
    same = Window.partitionBy("edge_text")
    edges = marked.filter("edge_text is not null").select(
        "slice",
        "edge",
        F.sum("size").over(same).alias("all_size"),
        F.min("slice").over(same).alias("first_slice"),
        F.min_by("keep", F.struct("slice", "edge")).over(same).alias("all_keep"),
    )
    # Two rows a slice at most, of four numbers each, so the broadcast grows with the number of slices alone.
    whole = marked.drop("edge_text").join(F.broadcast(edges), ["slice", "edge"], "left")
    is_edge = F.col("all_size").isNotNull()
    return whole.select(
        F.col("id").alias(id_col),
        F.when(is_edge, F.col("all_keep")).otherwise(F.col("keep")).alias("keep_id"),
        F.when(is_edge, F.col("all_size")).otherwise(F.col("size")).alias("group_size"),
        (F.col("head") & (~is_edge | (F.col("slice") == F.col("first_slice")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours in a sorted slice. Of the open run only ids and one text are held."""
    slice_no = TaskContext.get().partitionId()
    open_ids: list[pa.Array] = []
    open_text = open_sha = None
    closed = 0

    def own(ids: pa.Array, lo: int, hi: int) -> pa.Array:
        return ids.take(pa.array(np.arange(lo, hi)))  # a copy, so the batch of texts can go

    def close(edge: int) -> pa.RecordBatch:
        ids = pa.concat_arrays(open_ids)
        n = len(ids)
        head = np.zeros(n, bool)
        head[0] = True
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.repeat(open_sha, n),
                pa.repeat(pa.scalar(slice_no, pa.int32()), n),
                pa.repeat(pa.scalar(edge, pa.int32()), n),
                pa.array(head),
                pa.repeat(ids[0], n),
                pa.repeat(pa.scalar(n, pa.int64()), n),
                pa.array([open_text.as_py() if edge else None] + [None] * (n - 1), pa.string()),
            ],
            names=NAMES,
        )

    for batch in small_batches(batches):
        ids, texts, shas = batch.column("id"), batch.column("norm"), batch.column("sha")
        n = batch.num_rows
        if n == 0:
            continue
        starts = np.flatnonzero(pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1
        if open_text is None or texts[0].as_py() != open_text.as_py():
            if open_text is not None:
                yield close(INTERIOR if closed else FIRST)
                closed += 1
            open_ids = []
        bounds = np.concatenate([[0], starts, [n]])
        if len(starts):
            open_ids.append(own(ids, 0, int(starts[0])))
            open_text, open_sha = texts[0], shas[0]
            yield close(INTERIOR if closed else FIRST)
            closed += 1
            lo, hi = int(bounds[1]), int(bounds[-2])
            if hi > lo:  # runs that begin and end in this batch
                sizes = np.diff(bounds[1:-1])
                heads = np.repeat(bounds[1:-2], sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        shas.slice(lo, hi - lo),
                        pa.repeat(pa.scalar(slice_no, pa.int32()), hi - lo),
                        pa.repeat(pa.scalar(INTERIOR, pa.int32()), hi - lo),
                        pa.array(heads == np.arange(lo, hi)),
                        ids.take(pa.array(heads)),
                        pa.array(np.repeat(sizes, sizes)),
                        pa.nulls(hi - lo, pa.string()),
                    ],
                    names=NAMES,
                )
                closed += len(sizes)
            open_ids = []
        last = int(bounds[-2])
        open_ids.append(own(ids, last, n))
        open_text, open_sha = texts[last], shas[last]
    if open_text is not None:
        yield close(LAST if closed else FIRST)


NAMES = ["id", "sha", "slice", "edge", "head", "keep", "size", "edge_text"]
