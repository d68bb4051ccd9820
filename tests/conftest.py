from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pageframe.operators import pages as P  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def parse(spark):
    """parse(html, ...) -> parsed pages with page_id 0, 1, …"""

    def make(*htmls, url="https://w.example.com/a/b/c?z=1#top", keep=()):
        rows = [(i, url, html) for i, html in enumerate(htmls)]
        return P.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), *keep)

    return make


@pytest.fixture(scope="session")
def values():
    """Values of one column in page order."""

    def collect(df, name):
        return [row[name] for row in df.orderBy("page_id").collect()]

    return collect
