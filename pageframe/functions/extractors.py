"""User-supplied page extractors."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType


def by_row(extract: Callable[[str], dict]) -> Callable[[pa.Array], list]:
    """A batch function out of one for a single page; a null page has no result."""
    return lambda html: [None if h is None else extract(h) for h in html.to_pylist()]


def register_extractor(
    spark: SparkSession, name: str, extract: Callable[[pa.Array], pa.Array | list], ddl: str
) -> Callable[[Column | str], Column]:
    """Make `extract` a function for DataFrames and, under `name`, for SQL.

    It gets an Arrow array of pages, one batch at a time, and returns an array (or list) of as many results of the
    type `ddl`; `by_row` makes one out of a function of one page. For many rows per page, return an array and explode it.
    """
    returns: DataType = StructType.fromDDL(f"r {ddl}")["r"].dataType
    arrow_type = to_arrow_type(returns)

    def batch(html: pa.Array) -> pa.Array:
        found = extract(html)
        return found.cast(arrow_type) if isinstance(found, pa.Array) else pa.array(found, arrow_type)

    function = F.arrow_udf(batch, returns)
    spark.udf.register(name, function)
    return function
