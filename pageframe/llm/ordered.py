"""Numbers along an order that may have any number of rows under one key: range partitions, then a correction each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe.llm.texts import stored
from pageframe.operators.running import running_totals


def laid_out(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`df`, written in range partitions of (keys, order), with the number of the partition as `slice`."""
    return stored(df.repartitionByRange(*keys, *order).withColumn("slice", F.spark_partition_id()), "ordered")


def sums_before(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, str]) -> DataFrame:
    """Adds sums over the earlier rows of the same keys; `totals` maps new columns to the long columns they sum.

    A key of many rows is cut into slices, so a task never sees all of them.
    """
    up_to = running_totals(laid_out(df, keys, order), totals, keys, "slice", order)
    return up_to.withColumns({name: F.col(name) - F.col(value) for name, value in totals.items()}).drop("slice")


def largest_before(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the largest `value` among the earlier rows of the same keys, null where there is none."""
    laid = laid_out(df.withColumn("own", value), keys, order)
    inside = Window.partitionBy("slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = laid.groupBy(*keys, "slice").agg(F.max("own").alias("most"))  # a row a key and slice
    slices = slices.select(*keys, "slice", F.max("most").over(earlier).alias("most_before"))
    return (
        laid.withColumn(name, F.max("own").over(inside))
        .join(slices, [*keys, "slice"])
        .withColumn(name, F.greatest(name, "most_before"))
        .drop("own", "slice", "most_before")
    )
