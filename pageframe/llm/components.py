"""Connected components over an edge table, level by level, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageframe.llm.texts import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node reachable.

    Every node keeps a parent that only ever gets smaller. A round offers a node, and its parent, the smallest
    grandparent among the neighbours, so trees hook onto smaller ones and get flat; rounds grow with the logarithm of
    the longest path. Sums and minima are aggregated before the shuffle, and the joins meet unique keys on one side,
    so a hub of many edges is split by skew handling. Edges with a null end or with two equal ends count for nothing
    but their node.
    """
    ends = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()
    links = stored(ends.union(ends.select("b", "a")).distinct(), "component-links")
    parents = stored(
        links.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("parent")), "component-parents"
    )
    total = _total(parents)
    while True:
        grand = parents.join(
            parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand")), "parent"
        ).select("node", "parent", "grand")
        near = (
            links.join(grand.select(F.col("node").alias("b"), "grand"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("grand").alias("near"))
        )
        step = grand.join(near, "node")
        offers = step.select(
            F.explode(
                F.array(
                    F.struct(F.col("node"), F.least("near", "grand").alias("parent")),
                    F.struct(F.col("parent").alias("node"), F.least("near", "grand").alias("parent")),
                )
            ).alias("offer")
        ).select("offer.*")
        parents = stored(offers.groupBy("node").agg(F.min("parent").alias("parent")), "component-parents")
        before, total = total, _total(parents)
        if total == before:
            return parents.select("node", F.col("parent").alias("root"))


def _total(parents: DataFrame):
    """The sum of all parents; parents only get smaller, so an equal sum means that none has changed."""
    return parents.agg(F.sum(F.col("parent").cast("decimal(38,0)"))).first()[0]
