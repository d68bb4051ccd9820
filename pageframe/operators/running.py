"""Running totals and first-n that never put a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe.sources.checkpoints import cut_lineage


def running_totals(
    df: DataFrame, totals: dict[str, str], keys: list[str], slice_col: str, order: list[str]
) -> DataFrame:
    """Adds sums up to and including each row, per `keys`, in the order (`slice_col`, `order`).

    `totals` maps the new columns to the columns they sum. Rows are summed
    within their slice; the totals of earlier slices, one row per key and slice,
    are added from the side. `slice_col` must not decrease with `order` and its
    number of values per key must be small. `df` is read twice.
    """
    by_slice = Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, slice_col)
        .agg(*[F.sum(value).alias(f"{name}_sum") for name, value in totals.items()])
        .select(
            *keys,
            slice_col,
            *[F.coalesce(F.sum(f"{name}_sum").over(earlier), F.lit(0)).alias(f"{name}_before") for name in totals],
        )
    )
    return (
        df.withColumns({name: F.sum(value).over(by_slice) for name, value in totals.items()})
        .join(offsets, [*keys, slice_col])
        .withColumns({name: F.col(name) + F.col(f"{name}_before") for name in totals})
        .drop(*[f"{name}_before" for name in totals])
    )


def first_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first `n` rows in an order, for any n.

    The rows are range-partitioned; partitions before the n-th row are kept
    whole and only the one that holds it is cut.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {row["_part"]: row["count"] for row in ranged.groupBy("_part").count().collect()}
    room = n
    for boundary in sorted(sizes):
        if sizes[boundary] >= room:
            break
        room -= sizes[boundary]
    else:
        return ranged.drop("_part")
    whole = ranged.filter(F.col("_part") < boundary)
    cut = ranged.filter(F.col("_part") == boundary).orderBy(*order).limit(room)
    return whole.unionByName(cut).drop("_part")
