"""Sources: stored pages, line lists, artifacts, event logs, page bytes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe.functions import charset
from pageframe.functions.html_tree import explode_rows, strip

EVENT_DDL = (
    "ts timestamp, event string, url string, status string, retries int, proxy_id string, elapsed_ms long, "
    "reason string, mode string, links int, bytes long, sha256 string, thread int, ua_id int"
)
MANIFEST_DDL = "url string, path string, sha256 string, bytes long, content_type string"
CORRUPT = "_corrupt_record"


#: A session may ask for so many partitions of a scan before texts are parsed or searched. Unset, nothing is shuffled.
SPREAD_SETTING = "pageframe.spread.partitions"


def spread(df: DataFrame) -> DataFrame:
    """Deals an input out to as many partitions as the session names in SPREAD_SETTING.

    For inputs of a few files that cannot be split; parsing them costs far more than moving them. The caller decides,
    not the size of the data.
    """
    wanted = df.sparkSession.conf.get(SPREAD_SETTING, None)
    return df if df.isStreaming or not wanted else df.repartition(int(wanted))


#: Tasks for each core of the session that rows are dealt out to before pages are rendered from them.
TASKS_PER_CORE = 4


def spread_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Deals rows that are still small out by their keys, before long texts are made of them.

    A table of a few columns is one or two partitions of a scan however many pages come of it. What moves are the rows
    of the table, never the texts. A session that names a number in SPREAD_SETTING has it done by `spread`.
    """
    spark = df.sparkSession
    if spark.conf.get(SPREAD_SETTING, None):
        return df
    return df.repartition(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, *keys)


#: Spark's limit on the bytes of an Arrow batch, and what rows of whole texts need of it.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """Has the session send rows to Python in Arrow batches of about BATCH_BYTES; a lower limit of its own stays.

    By default a batch is 10,000 rows up to 64 MB, however long their texts, and an executor holds several of them for
    each task: in its buffers, on their way, and in the worker. Rows and results are the same.
    """
    conf = df.sparkSession.conf
    limit = re.fullmatch(r"(\d+)([kmgtp]?)b?", conf.get(BATCH_SETTING).lower())
    if limit is None or int(limit[1]) << 10 * " kmgtp".index(limit[2] or " ") > BATCH_BYTES:
        conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    return df


def usable_pages(pages: DataFrame) -> DataFrame:
    """Pages that hold any markup."""
    return pages.filter(F.col("html").isNotNull() & (F.trim("html") != ""))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return usable_pages(spark.read.parquet(path).select("page_id", "url", "html"))


def lines_of(df: DataFrame, text_col: str, must_contain: str | None = None) -> DataFrame:
    """Stripped non-blank lines of a text column, as `line`."""
    lines = explode_rows(spread(df.select(text_col)), [], F.split(text_col, "\n"), "line")
    return _clean_lines(lines, must_contain)


def read_lines(spark: SparkSession, path: str, must_contain: str | None = None) -> DataFrame:
    return _clean_lines(spark.read.text(path).withColumnRenamed("value", "line"), must_contain)


def _clean_lines(lines: DataFrame, must_contain: str | None) -> DataFrame:
    kept = lines.select(strip(F.col("line")).alias("line")).filter("line != ''")
    return kept if must_contain is None else kept.filter(F.col("line").contains(must_contain))


def with_digest(df: DataFrame, content_col: str = "content") -> DataFrame:
    return df.withColumns(
        {"sha256": F.sha2(content_col, 256), "bytes": F.octet_length(content_col).cast("long")}
    )


def read_artifacts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files with hash and size."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return with_digest(reader.load(path)).select("path", "modificationTime", "content", "sha256", "bytes")


def read_events(spark: SparkSession, path: str, schema: str = EVENT_DDL) -> DataFrame:
    """Event lines with a fixed schema. Lines that are not JSON are kept in `_corrupt_record`."""
    return (
        spark.read.schema(f"{schema}, {CORRUPT} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_DDL).json(path)


def decode_pages(df: DataFrame, content: str = "content", content_type: str = "content_type") -> DataFrame:
    """Adds `text` and `encoding` for a binary column."""
    decoded = charset.decode(F.col(content), F.coalesce(content_type, F.lit("")))
    return spread(df).withColumn("decoded", decoded).select(*df.columns, "decoded.text", "decoded.encoding")
