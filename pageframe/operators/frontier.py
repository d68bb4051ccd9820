"""Deduplication, crawl routing and breadth-first expansion over a stored link graph."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.operators.running import first_rows
from pageframe.operators.url_filters import is_crawlable, is_downloadable
from pageframe.sources.checkpoints import cut_lineage


def dedup_urls(df: DataFrame) -> DataFrame:
    """Every URL once, at its smallest depth."""
    return df.groupBy("url").agg(F.min("depth").alias("depth"))


def _bucketed(df: DataFrame, buckets: int, *keys: str) -> str:
    """Name of a new table of `df`, bucketed, in the session's warehouse; dropping it deletes its files."""
    name = f"pageframe_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).format("parquet").saveAsTable(name)
    return name


def _salted_edges(edges: DataFrame, buckets: int, salt_edges: int) -> tuple[str, DataFrame]:
    """(table of the edges bucketed by src and salt, salts of the sources that have several).

    The edges of every source are cut into as many salts as it has times
    `salt_edges` edges. As a bucketed table they are shuffled once, not once per level.
    """
    degrees = edges.groupBy("src").agg(F.ceil(F.count("*") / salt_edges).cast("int").alias("salts"))
    several = cut_lineage(degrees.filter("salts > 1"))
    salts = F.coalesce("salts", F.lit(1))
    salt = F.pmod(F.xxhash64("dst"), salts).cast("int")
    salted = edges.join(several, "src", "left").select("src", "dst", salt.alias("salt")).distinct()
    return _bucketed(salted, buckets, "src", "salt"), several


def crawl_frontier(
    edges: DataFrame,
    seeds: DataFrame,
    max_depth: int = 3,
    max_urls: int | None = None,
    domain: str | None = None,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    buckets: int | None = None,
    salt_edges: int = 100_000,
) -> DataFrame:
    """url and depth of everything reachable from `seeds` (url) over `edges` (src, dst).

    Links that the filters reject are cut before the first level. The edges are
    bucketed once by source, and what each level found by URL, in `buckets`
    buckets (the shuffle partitions by default), so a level shuffles its own
    frontier and what it finds, neither the edges nor the visited URLs. Visited
    levels are merged into runs, each less than half as large as the one before,
    so a level is compared with no more runs than the logarithm of what is
    visited, and a URL is written anew as often. With `max_urls` the first URLs
    by depth, then URL, are kept. The tables are dropped at the end; the result
    is stored in the shared folder.
    """
    usable = edges.filter(is_crawlable(F.col("dst"), domain, include, exclude)).select("src", "dst")
    spark = edges.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    start = seeds.filter(is_crawlable(F.col("url"), domain, include, exclude)).select("url").distinct()
    tables: list[str] = []
    try:
        edge_table, several = _salted_edges(usable, buckets, salt_edges)
        tables.append(edge_table)
        return _levels(spark.table(edge_table), start, several, buckets, max_depth, max_urls, tables)
    finally:
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def _levels(
    edges: DataFrame,
    start: DataFrame,
    several: DataFrame,
    buckets: int,
    max_depth: int,
    max_urls: int | None,
    tables: list[str],
) -> DataFrame:
    spark = edges.sparkSession
    several = several.select(F.col("src").alias("url"), "salts")
    runs: list[tuple[str, int]] = []  # tables of what is visited, bucketed alike, and their rows

    def store(df: DataFrame) -> str:
        tables.append(_bucketed(df, buckets, "url"))
        return tables[-1]

    def keep(found: DataFrame, depth: int) -> tuple[DataFrame, int]:
        name = store(found.withColumn("depth", F.lit(depth)))
        n = spark.table(name).count()
        runs.append((name, n))
        while len(runs) > 1 and 2 * runs[-1][1] >= runs[-2][1]:
            (older, n_older), (newer, n_newer) = runs[-2:]
            runs[-2:] = [(store(spark.table(older).unionByName(spark.table(newer))), n_older + n_newer)]
            if older != name:
                spark.sql(f"DROP TABLE {older}")
                tables.remove(older)
        return spark.table(name), n

    level, n_visited = keep(_first(start, max_urls), 0)
    for depth in range(1, max_depth + 1):
        if max_urls is not None and n_visited >= max_urls:
            break
        salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
        frontier = level.join(several, "url", "left").select(F.col("url").alias("src"), F.explode(salts).alias("salt"))
        new = edges.join(frontier, ["src", "salt"]).select(F.col("dst").alias("url")).distinct()
        for name, _ in runs:
            new = unvisited(new, spark.table(name))
        level, n_level = keep(_first(new, None if max_urls is None else max_urls - n_visited), depth)
        if n_level == 0:
            break
        n_visited += n_level
    found = spark.table(runs[0][0])
    for name, _ in runs[1:]:
        found = found.unionByName(spark.table(name))
    return cut_lineage(found)


def unvisited(urls: DataFrame, visited: DataFrame) -> DataFrame:
    """URLs that are not in `visited`, a table bucketed by URL, which is read as it lies."""
    return urls.join(visited.hint("merge").select("url"), "url", "left_anti")


def _first(urls: DataFrame, n: int | None) -> DataFrame:
    return urls if n is None else first_rows(urls, n, F.col("url"))


def link_route(url: Column, depth: Column, max_depth: int, extensions, domain=None, include=None, exclude=None) -> Column:
    """download, enqueue or drop."""
    return (
        F.when(is_downloadable(url, extensions), "download")
        .when(is_crawlable(url, domain, include, exclude) & (depth < max_depth), "enqueue")
        .otherwise("drop")
    )


def route_links(links: DataFrame, max_depth: int, extensions, domain=None, include=None, exclude=None) -> DataFrame:
    """Links per page (page_id, url, depth) by what becomes of them."""
    route = link_route(F.col("url"), F.col("depth"), max_depth, extensions, domain, include, exclude)
    routed = links.withColumn("route", route)
    return routed.groupBy("page_id").agg(
        *[F.count_if(F.col("route") == name).alias(name) for name in ("download", "enqueue", "drop")]
    )


def mark_duplicates(df: DataFrame) -> DataFrame:
    """status "start" for the first download (url, seq) of a URL and "duplicate" for later ones.

    The first `seq` per URL is joined back on (url, seq), a key no row shares,
    so a URL asked for by a third of the rows does not load one task.
    """
    firsts = df.groupBy("url").agg(F.min("seq").alias("seq")).withColumn("first", F.lit(True))
    status = F.when(F.col("first"), "start").otherwise("duplicate")
    return df.join(firsts, ["url", "seq"], "left").withColumn("status", status).drop("first")


def ordered_distinct(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """Distinct values per key at the position each first appears."""
    return df.groupBy(*keys, value).agg(F.min(position).alias(position))


def keep_newest(df: DataFrame, n: int, key: str, ts: str, touch: bool = False) -> DataFrame:
    """The `n` newest keys. A key counts from its first appearance, or with `touch` from its last."""
    seen = F.max(ts) if touch else F.min(ts)
    return first_rows(df.groupBy(key).agg(seen.alias("seen")), n, F.desc("seen"), F.desc(key))


def collect_pages(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; a column a part lacks is NULL there."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def first_match(hits: DataFrame, keys: list[str], rank: str, order: str, value: str) -> DataFrame:
    """Per key, the value of the best rank, and among those the first."""
    return hits.groupBy(*keys).agg(F.min_by(value, F.struct(rank, order)).alias(value), F.min(rank).alias(rank))


def needs_render_pages(pages: DataFrame, links: DataFrame, extensions, exclude=None) -> DataFrame:
    """Pages none of whose static links is a target file."""
    targets = links.filter(is_downloadable(F.col("url"), extensions, exclude)).select("page_id").distinct()
    return pages.join(targets, "page_id", "left_anti")


# --- endpoint lists -------------------------------------------------------------


def clean_endpoints(lines: DataFrame) -> DataFrame:
    """Distinct host:port endpoints of a line list, with their kind."""
    named = F.regexp_extract(F.lower("line"), "^(socks5|socks4|https|http|socks)://", 1)
    kind = F.when(named == "socks", "socks5").when(named == "", "http").otherwise(named)
    # one web prefix, then one socks prefix, as written; prefixes are removed in lower case only
    bare = F.regexp_replace(F.regexp_replace("line", "^https?://", ""), "^socks[45]?://", "")
    bare = F.regexp_replace(bare, "/.*$", "")
    host = F.substring_index(bare, ":", 1)
    port = F.regexp_extract(bare, r"^[^:]*:\s*([+]?[0-9]+)\s*$", 1).try_cast("bigint")
    endpoints = lines.select(bare.alias("endpoint"), kind.alias("kind"), host.alias("host"), port.alias("port"))
    return endpoints.filter((F.length("host") >= 3) & F.col("port").between(1, 65535)).distinct()


def top_k(df: DataFrame, k: int, by: str, ascending: bool = True, tie: str | None = None) -> DataFrame:
    """The first `k` rows by a column, for a report: every task keeps k rows and one merges them.

    For a `k` that grows with the data use `running.first_rows`.
    """
    return df.orderBy(F.asc(by) if ascending else F.desc(by), *([F.asc(tie)] if tie else [])).limit(k)
