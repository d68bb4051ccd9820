"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside them, components over the links."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.llm.components import components
from pageframe.llm.texts import stored

#: Vectors a cell should have, vectors that k-means sees for each cell and at most, its rounds, and rows of a block.
CELL_SIZE, SAMPLE_PER_CELL, SAMPLE_MOST, ROUNDS, BLOCK = 512, 40, 40_000, 8, 2048


def usable(vector: str) -> Column:
    """Vectors with a direction: not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component is taken out first, so that squares cannot overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Unit centroids of `sample` (unit rows): each round moves them to the mean direction of their vectors."""
    rng = np.random.default_rng(seed)
    centroids = sample[np.sort(rng.choice(len(sample), min(k, len(sample)), replace=False))]
    for _ in range(rounds):
        home = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def fit_cells(vectors: DataFrame, count: int, cell_size: int = CELL_SIZE) -> dict[int, np.ndarray]:
    """Centroids by dimension, from about SAMPLE_PER_CELL vectors a cell, SAMPLE_MOST at most.

    The sample is taken by a hash of the vector, so it is the same in every run. All else covers every vector.
    """
    cells = max(1, count // cell_size)
    wanted = min(SAMPLE_MOST, cells * SAMPLE_PER_CELL, count)
    share = F.pmod(F.xxhash64(F.lit(3), "vector"), F.lit(1_000_000)) < int(1_000_000 * wanted / max(1, count)) + 1
    by_size: dict[int, list] = {}
    for row in vectors.filter(share).select("vector").collect():
        by_size.setdefault(len(row["vector"]), []).append(row["vector"])
    cells = max(1, min(cells, wanted // (SAMPLE_PER_CELL // 4)))
    return {
        size: spherical_kmeans(unit_rows(np.array(sorted(rows), float)), max(1, cells * len(rows) // wanted))
        for size, rows in by_size.items()
    }


def centroid_distances(centroids: np.ndarray) -> np.ndarray:
    """Distances of all centroids, never too small; one number for a pair of them, whatever their dimension."""
    squares = (centroids * centroids).sum(axis=1)
    return np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * centroids @ centroids.T, 0)) + 1e-6


def _assign(models: dict[int, np.ndarray], threshold: float):
    """The own cell of each vector, and the cells that it visits: those whose border it lies close to.

    Linked vectors lie within `radius` of each other, so of two on both sides of a border one is within half of it.
    """
    radius = sqrt(max(0.0, 2.0 - 2.0 * threshold) + 1e-12)  # rounded products may link slightly farther ones

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column("vector")
            sizes = np.diff(np.asarray(lists.offsets))
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(rows))
                x = unit_rows(part.column("vector").flatten().to_numpy().astype(float).reshape(len(rows), size))
                centroids = models.get(int(size), np.eye(1, size))
                if size not in distances:
                    distances[size] = centroid_distances(centroids)
                apart = distances[size]
                for at in range(0, len(rows), 4096):
                    some = part.slice(at, 4096)
                    likeness = x[at : at + 4096] @ centroids.T
                    home = likeness.argmax(axis=1)
                    own = np.arange(len(home))
                    near = likeness[own, home][:, None] - likeness <= radius / 2 * apart[home] + 1e-9
                    near[own, home] = False
                    visits = [np.flatnonzero(row).astype(np.int32) for row in near]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(home), size, np.int32)),
                            some.column("node"),
                            some.column("n"),
                            some.column("vector"),
                            pa.array(home.astype(np.int32)),
                            pa.array(visits, pa.list_(pa.int32())),
                        ],
                        names=["size", "node", "n", "vector", "home", "visits"],
                    )

    return run


def _meetings(placed: DataFrame, block: int) -> DataFrame:
    """A row of each vector for every pair of blocks (size, cell, i, j) that it is in, made while they are shuffled.

    The homes of a cell, its blocks from 0 on, meet each other and the blocks of its visitors, which follow and are
    up to four times as long. Two visitors of a cell do not meet there.
    """
    homes = placed.groupBy("size", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / block).cast("int").alias("own"))
    guests = placed.select("size", F.explode("visits").alias("cell")).groupBy("size", "cell").count()
    shape = homes.join(guests, ["size", "cell"], "left").select(
        "size", "cell", "own", F.ceil(F.coalesce("count", F.lit(0)) / (4 * block)).cast("int").alias("strange")
    )
    at_home = F.col("home") == F.col("cell")
    place = F.xxhash64("node")
    return (
        placed.withColumn("cell", F.explode(F.concat(F.array("home"), "visits")))
        .withColumn("visits", F.when(at_home, F.col("visits")))
        .join(F.broadcast(shape), ["size", "cell"])  # as many rows as there are centroids
        .withColumn("block", F.when(at_home, F.pmod(place, "own")).otherwise(F.col("own") + F.pmod(place, "strange")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("own") + F.when(at_home, F.col("strange")).otherwise(0) - 1)))
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        .select("size", "cell", "i", "j", "block", "node", "n", "vector", "home", "visits")
    )


def _compare(threshold: float, block: int):
    """Links of one pair of blocks: their number for each vector, and a tree of links for each connected part.

    A pair of two homes of different cells may meet in both of them; then the lower cell counts it.
    """

    def side(table: pa.Table, wanted: int, size: int) -> tuple[np.ndarray, ...]:
        rows = table.filter(pa.compute.equal(table["block"], wanted)).sort_by("node").combine_chunks()
        x = np.concatenate([np.zeros(0), *[c.flatten().to_numpy().astype(float) for c in rows["vector"].chunks]])
        x = x.reshape(rows.num_rows, size)
        return rows, (unit_rows(x) if len(x) else x), rows["node"].to_numpy(), rows["n"].to_numpy()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        size, cell, i, j = (part.as_py() for part in key)
        u, x, u_nodes, u_n = side(table, i, size)
        v, y, v_nodes, v_n = (u, x, u_nodes, u_n) if i == j else side(table, j, size)
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
        if not len(x) or not len(y):
            return schema.empty_table()
        near = np.concatenate([x @ y[at : at + block].T >= threshold for at in range(0, len(y), block)], axis=1)
        v_home = v["home"].to_numpy()
        if v_home[0] != cell:  # visitors: a home of this cell may visit them in a lower one
            lower = np.zeros((len(x), v_home.max() + 1), bool)
            for row, visits in enumerate(u["visits"].to_pylist()):
                lower[row, [c for c in visits if c < min(cell, lower.shape[1])]] = True
            near &= ~lower[:, v_home]
        elif i == j:
            near &= np.triu(np.ones(near.shape, bool), 1)
        at = np.flatnonzero(near.any(axis=1))
        if not len(at):
            return schema.empty_table()
        near = near[at]
        u_nodes = u_nodes[at]
        u_links = near @ v_n
        v_links = u_n[at] @ near
        edges: list[tuple[int, int]] = []
        left = np.ones(len(at), bool)
        while left.any():  # one connected part after the other, each row looked at once
            front = np.array([int(left.argmax())])
            found, reached = [], np.zeros(near.shape[1], bool)
            while len(front):
                left[front] = False
                found.extend(front.tolist())
                fresh = near[front].any(axis=0) & ~reached
                reached |= fresh
                front = np.flatnonzero(near[:, fresh].any(axis=1) & left)
            nodes = np.concatenate([u_nodes[found], v_nodes[reached]])
            edges.extend((int(nodes.min()), int(node)) for node in np.unique(nodes))
        tree = pd.DataFrame(edges, columns=["a", "b"]).assign(links=0)
        counts = pd.DataFrame(
            {"a": np.concatenate([u_nodes, v_nodes]), "links": np.concatenate([u_links, v_links])}
        ).query("links > 0")
        out = pd.concat([tree, counts.assign(b=counts["a"])])[["a", "b", "links"]].astype("int64")
        return pa.Table.from_pandas(out, schema, preserve_index=False)

    return run


def embedding_dedup(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    cell_size: int = CELL_SIZE,
    block: int = BLOCK,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: links at a cosine of at least `threshold`, in doubles.

    Equal vectors are one node, whatever their number. k-means over a bounded sample gives cells; every vector is
    indexed in its own cell and visits those whose border lies within half the largest distance of linked vectors,
    which finds every link however the vectors lie. A cell is cut into blocks, and pairs of blocks are compared by one
    matrix product each, so neither a large cell nor a dense group meets in one task. A pair of blocks returns numbers of links and one tree for each connected part,
    never the pairs. Only vectors of one dimension are compared.

    Vectors that are null, zero, or hold null or non-finite components link with nothing. Repeated rows link with each
    other. `component_id` is the smallest id reachable, `kept` says that it is the row's own; rows without an id are
    not kept, and take their component's id where it has one. No rows give no rows.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).withColumn("usable", usable("vector"))
    nodes = stored(
        rows.filter("usable")
        .groupBy("vector")
        .agg(F.count("*").alias("n"))
        .select(F.monotonically_increasing_id().alias("node"), "n", "vector"),
        "embedding-nodes",
    )
    models = fit_cells(nodes, nodes.count(), cell_size)
    placed = stored(
        nodes.mapInArrow(
            _assign(models, threshold),
            f"size int, node long, n long, vector {nodes.schema['vector'].dataType.simpleString()}, home int, visits array<int>",
        ),
        "embedding-cells",
    )
    met = _meetings(placed, block).groupBy("size", "cell", "i", "j")
    found = stored(met.applyInArrow(_compare(threshold, block), "a long, b long, links long"), "embedding-links")
    links = found.filter("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    parts = components(found.filter("links = 0"))
    known = stored(
        nodes.join(links, "node", "left")
        .join(parts, "node", "left")
        .select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")),
        "embedding-known",
    )
    linked = stored(rows.filter("usable").select("id", "vector").join(known, "vector").select("id", "n_links", "root"), "embedding-rows")
    smallest = linked.groupBy("root").agg(F.min("id").alias("component_id"))
    alone = rows.filter("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = linked.join(smallest, "root").select("id", "n_links", "component_id").unionByName(alone)
    return every.select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
