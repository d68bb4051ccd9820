"""As-of joins: the last earlier row of the same keys, for any number of rows a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageframe.sources.checkpoints import cut_lineage


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, fields: dict[str, str], tie: str | None = None) -> DataFrame:
    """Every row of `left` with the fields of the last row of `right` that has the same keys and is not later at `at`.

    `fields` maps new columns to columns of `right`; they are null where there
    is no such row. Of rows of `right` at the same instant the one with the
    largest `tie` counts. Keys and instants that are null match nothing.

    Both sides are range-partitioned together in the order (keys, at), and
    stored. A partition carries the last value along itself; what comes in from
    the partitions before is one small row for each key and partition. So no
    key is gathered in a task, and `right` may hold any part of its rows under one.
    """
    value = F.struct(*[F.col(column).alias(name) for name, column in fields.items()])
    order = [*keys, "asof_at", "asof_side", "asof_tie"]
    key_columns = [F.col(key) for key in keys]
    rows = left.select(
        *key_columns,
        F.col(at).alias("asof_at"),
        F.lit(1).alias("asof_side"),
        F.lit(None).cast(right.schema[tie].dataType if tie else "int").alias("asof_tie"),
        F.struct(*[F.col(f"`{name}`") for name in left.columns]).alias("asof_row"),
    )
    values = right.filter(F.col(at).isNotNull()).select(
        *key_columns,
        F.col(at).alias("asof_at"),
        F.lit(0).alias("asof_side"),
        F.col(tie).alias("asof_tie") if tie else F.lit(None).cast("int").alias("asof_tie"),
        value.alias("asof_value"),
    )
    laid = rows.unionByName(values, allowMissingColumns=True).repartitionByRange(*order)
    laid = cut_lineage(laid.withColumn("asof_part", F.spark_partition_id()))
    inside = Window.partitionBy("asof_part", *keys).orderBy(*order[len(keys) :]).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("asof_part").rowsBetween(Window.unboundedPreceding, -1)
    lasts = (
        laid.filter("asof_side = 0")
        .groupBy(*keys, "asof_part")
        .agg(F.max_by("asof_value", F.struct("asof_at", "asof_tie")).alias("last"))
        .unionByName(laid.filter("asof_side = 1").select(*keys, "asof_part").distinct(), allowMissingColumns=True)
        .groupBy(*keys, "asof_part")
        .agg(F.first("last", ignorenulls=True).alias("last"))
    )
    carried = lasts.select(*keys, "asof_part", F.last("last", ignorenulls=True).over(earlier).alias("asof_carried"))
    known = laid.withColumn("asof_own", F.last("asof_value", ignorenulls=True).over(inside)).filter("asof_side = 1")
    same = [known[key].eqNullSafe(carried[key]) for key in keys] + [known["asof_part"] == carried["asof_part"]]
    whole = F.lit(True)
    for key in keys:
        whole = whole & known[key].isNotNull()
    found = F.when(whole & known["asof_at"].isNotNull(), F.coalesce("asof_own", "asof_carried"))
    joined = known.join(carried, same).select("asof_row", found.alias("asof_found"))
    return joined.select("asof_row.*", *[F.col("asof_found")[name].alias(name) for name in fields])
