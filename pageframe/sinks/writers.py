"""Sinks. Every writer takes a folder; rows go out in parallel, one file per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageframe.operators.frontier import top_k
from pageframe.operators.records import file_inventory, flat_pages
from pageframe.sources.checkpoints import cut_lineage
from pageframe.sources.readers import MANIFEST_DDL

PRODUCT_COLUMNS = ["title", "price", "description", "reviews", "image", "url", "source_url", "extracted_at"]


def write_pages_json(records: DataFrame, folder: str) -> None:
    records.write.mode("overwrite").json(folder)


def _csv(writer, folder: str) -> None:
    # quotes are doubled and white space is kept, so any text reads back as written
    writer.options(
        header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(folder)


def write_pages_csv(records: DataFrame, folder: str) -> None:
    _csv(flat_pages(records).write.mode("overwrite"), folder)


def product_rows(products: DataFrame, run_ts: str) -> DataFrame:
    """Products in file order of columns; a field not found is empty."""
    stamped = products.withColumn("extracted_at", F.lit(run_ts))
    return stamped.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in PRODUCT_COLUMNS])


def write_products(products: DataFrame, folder: str, run_id: str, run_ts: str) -> None:
    """JSON and CSV, one partition per run: writing a run again replaces only that run."""
    rows = product_rows(products, run_ts).withColumn("run_id", F.lit(run_id))

    def writer(df: DataFrame):
        return df.write.mode("overwrite").partitionBy("run_id").option("partitionOverwriteMode", "dynamic")

    writer(rows).json(f"{folder}/json")
    # the CSV is made from the stored JSON of the run, so pages are parsed once
    back = products.sparkSession.read.schema(rows.schema).json(f"{folder}/json")
    _csv(writer(back.filter(F.col("run_id") == run_id)), f"{folder}/csv")


def write_tables(tables: DataFrame, folder: str, run_ts: str, run_id: str = "run") -> None:
    """One line per table: source_url, extracted_at, table_no, headers, rows; writing a run again replaces that run."""
    rows = tables.select(
        F.col("url").alias("source_url"), F.lit(run_ts).alias("extracted_at"), "page_id", "table_no", "headers", "rows"
    ).withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").partitionBy("run_id").option("partitionOverwriteMode", "dynamic").json(folder)


def manifest_rows(artifacts: DataFrame) -> DataFrame:
    names = [field.strip().split(" ")[0] for field in MANIFEST_DDL.split(",")]
    return artifacts.select(*names)


def write_manifest(artifacts: DataFrame, folder: str) -> None:
    manifest_rows(artifacts).write.mode("append").json(folder)


def write_events(events: DataFrame, folder: str) -> None:
    """NDJSON; fields a row lacks are left out of its line."""
    events.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(folder)


def ranked_lines(df: DataFrame, k: int = 50) -> DataFrame:
    """endpoint, plain and detailed line of the k fastest endpoints (endpoint, seconds, kind)."""
    best = top_k(df, k, "seconds", tie="endpoint")
    return best.select(
        F.col("endpoint").alias("plain"),
        F.format_string("%s %.3fs %s", "endpoint", "seconds", "kind").alias("detailed"),
        "seconds",
    )


def write_ranked(df: DataFrame, folder: str, k: int = 50) -> None:
    """Two text files of at most k lines each, in order; k is the length of a report."""
    lines = cut_lineage(ranked_lines(df, k).orderBy("seconds", "plain").coalesce(1))
    lines.select(F.col("plain").alias("value")).write.mode("overwrite").text(f"{folder}/plain")
    lines.select(F.col("detailed").alias("value")).write.mode("overwrite").text(f"{folder}/detailed")


def write_discoveries(files: DataFrame, endpoints: DataFrame, folder: str) -> None:
    """The two documents of a discovery dump: the endpoints, and the files with a line of counts for each type."""
    endpoints.select("api_url", "first_page_id", "n_pages").write.mode("overwrite").json(f"{folder}/endpoints")
    files.write.mode("overwrite").json(f"{folder}/files")
    back = files.sparkSession.read.schema(files.schema).json(f"{folder}/files")
    file_inventory(back).write.mode("overwrite").json(f"{folder}/file_counts")


def write_payloads(decoded: DataFrame, folder: str) -> None:
    """Decoded artifacts with their manifest fields, content included."""
    decoded.select("file_name", "content", "sha256", "bytes").write.mode("append").parquet(folder)
