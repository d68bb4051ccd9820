"""URL filters and classifiers over a `url` column."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe.functions import urls as U
from pageframe.functions.constants import EXTENSION_CATEGORIES, MIME_EXTENSIONS, OCTET_STREAM_PATHS
from pageframe.operators.running import running_totals
from pageframe.sources.checkpoints import cut_lineage


def normal_extensions(extensions) -> list[str]:
    return [e.lower().lstrip(".") for e in extensions or []]


def with_url_parts(df: DataFrame, col: str = "url") -> DataFrame:
    url = F.col(col)
    return df.withColumns(
        {
            "scheme": U.scheme(url),
            "authority": U.authority(url),
            "path": U.path(url),
            "query": U.query(url),
            "fragment": U.fragment(url),
            "ext": U.url_extension(url),
        }
    )


def is_crawlable(url: Column, domain: str | None = None, include=None, exclude=None) -> Column:
    """Same authority or none, no excluded part, and an included part when any are given."""
    test = url.isNotNull() & (url != "")
    if domain is not None:
        test = test & U.authority(url).isin("", domain)
    if exclude:
        test = test & ~U.contains_any(url, exclude)
    if include:
        test = test & U.contains_any(url, include)
    return test


def crawlable(links: DataFrame, domain=None, include=None, exclude=None, visited: DataFrame | None = None) -> DataFrame:
    return _unvisited(links.filter(is_crawlable(F.col("url"), domain, include, exclude)), visited)


# URLs a page crawl has no use for.
ASSET_PATTERNS = r"\.(css|js)$|\.(jpg|jpeg|png|gif|bmp|svg|webp)$"
SKIPPED_PATTERNS = r"javascript:|mailto:|tel:|#"


def valid_urls(
    links: DataFrame, domain=None, base_path=None, filetypes=None, dump_all=False, visited: DataFrame | None = None
) -> DataFrame:
    """The stricter filter for one site: no fragments, no assets unless wanted, below `base_path`."""
    url = F.col("url")
    wanted = [f".{ext}" for ext in normal_extensions(filetypes)]
    path = F.lower(U.path(url))

    def ends_with_wanted(text):
        return reduce(or_, [text.endswith(ending) for ending in wanted], F.lit(False))

    test = ~url.rlike(f"(?i){SKIPPED_PATTERNS}") & (url != "")
    if not dump_all:
        test = test & (~url.rlike(f"(?i){ASSET_PATTERNS}") | ends_with_wanted(F.lower(url)))
    if domain is not None:
        test = test & (U.authority(url) == domain)
    unvisited = test
    if not dump_all and wanted:
        last = F.substring_index(path, ".", -1)
        unvisited = unvisited & (~path.contains(".") | last.isin([w[1:] for w in wanted]))
    if base_path and not dump_all:
        below = U.path(url).startswith(base_path)
        # a wanted file outside the base path counts even when it was seen before
        outside = test & ~below & ends_with_wanted(path)
        return _unvisited(links.filter((unvisited & below) | outside), visited, outside)
    return _unvisited(links.filter(unvisited), visited)


def _unvisited(df: DataFrame, visited: DataFrame | None, anyway: Column | None = None) -> DataFrame:
    """Rows whose URL is not visited, or for which `anyway` holds; one pass over the links."""
    if visited is None:
        return df
    seen = visited.select("url").distinct().withColumn("seen", F.lit(True))
    unseen = F.col("seen").isNull()
    kept = df.join(seen, "url", "left").filter(unseen if anyway is None else unseen | anyway)
    return kept.select(*df.columns)


def is_downloadable(url: Column, extensions=None, exclude=None, crawl_only: bool = False) -> Column:
    """Whether a URL is a file to keep, by extension alone."""
    if crawl_only:
        return F.lit(False)
    wanted, unwanted = normal_extensions(extensions), normal_extensions(exclude)
    name = F.when(url.startswith("blob:"), F.get(F.split(url, ":", 3), F.lit(1))).otherwise(U.path(url))
    ext = U.extension(name)
    local = url.startswith("blob:") | url.startswith("file:///")
    in_list = ext.isin(wanted) if wanted else F.lit(False)
    local_ok = F.when(ext != "", in_list).otherwise(True) if wanted else F.lit(True)
    web_ok = in_list & ~ext.isin(unwanted) if unwanted else in_list
    return F.coalesce(F.when(local, local_ok).otherwise(web_ok & (ext != "")), F.lit(False))


def downloadable(links: DataFrame, extensions=None, exclude=None, crawl_only: bool = False) -> DataFrame:
    return links.filter(is_downloadable(F.col("url"), extensions, exclude, crawl_only))


def mime_table(spark) -> DataFrame:
    return spark.createDataFrame(list(MIME_EXTENSIONS.items()), "mime string, mime_ext string")


def mime_ext(df: DataFrame, extensions) -> DataFrame:
    """URLs without extension, classified by their content type.

    Adds `mime_ext` and `is_file`. The lookup has a fixed 42 rows, so it is broadcast.
    """
    wanted = normal_extensions(extensions)
    bare = df.filter(U.url_extension(F.col("url")) == "")
    mime = F.lower(F.trim(F.substring_index("content_type", ";", 1)))
    joined = bare.withColumn("mime", mime).join(F.broadcast(mime_table(df.sparkSession)), "mime", "left")
    octet = (F.col("mime") == "application/octet-stream") & U.contains_any(F.lower(U.path(F.col("url"))), OCTET_STREAM_PATHS)
    is_file = F.col("mime_ext").isin(wanted) if wanted else F.lit(False)
    return joined.withColumn("is_file", F.coalesce(is_file, F.lit(False)) | F.coalesce(octet, F.lit(False)))


def target_files(links: DataFrame, extensions, exclude=None) -> DataFrame:
    return downloadable(links, extensions, exclude)


def pages_with_targets(links: DataFrame, extensions, exclude=None) -> DataFrame:
    """page_id and whether any of its links is a target file."""
    return links.groupBy("page_id").agg(
        F.bool_or(is_downloadable(F.col("url"), extensions, exclude)).alias("has_targets"),
        F.count_if(is_downloadable(F.col("url"), extensions, exclude)).alias("n_targets"),
    )


def extension_table() -> dict[str, str]:
    """extension -> category; the first category to list an extension owns it."""
    table: dict[str, str] = {}
    for category, names in EXTENSION_CATEGORIES.items():
        for ext in names:
            table.setdefault(ext, category)
    return table


def all_extensions() -> list[str]:
    return list(extension_table())


def ext_category(df: DataFrame, col: str = "url") -> DataFrame:
    """Adds `ext` and `category`; unknown extensions have none."""
    rows = df.sparkSession.createDataFrame(list(extension_table().items()), "ext string, category string")
    return df.withColumn("ext", U.url_extension(F.col(col))).join(F.broadcast(rows), "ext", "left")


KEY_DIGITS = 4  # leading hex digits of the URL key: up to 65,536 slices of a group


NUMBERS = 65_536  # numbers of a path that are counted in one slice


def _stem_and_ext(path: Column) -> tuple[Column, Column]:
    ext = F.regexp_extract(path, r"[^./][^/]*(\.[^./]*)$", 1)
    return F.substr(path, F.lit(1), F.length(path) - F.length(ext)), ext


def _taken_numbers(paths: DataFrame) -> DataFrame:
    """(path, k): numbers that a path may not be given, as some URL is stored under the numbered path itself."""
    stem, ext = _stem_and_ext(F.col("path"))
    number = F.regexp_extract(stem, r"_([1-9][0-9]{0,17})$", 1)
    base = F.concat(F.substr(stem, F.lit(1), F.length(stem) - F.length(number) - 1), ext)
    numbered = paths.filter(number != "").select(base.alias("path"), number.cast("long").alias("k")).distinct()
    return numbered.join(paths, "path", "left_semi")


def _free_numbers(repeats: DataFrame, taken: DataFrame) -> DataFrame:
    """(path, n, k): the n-th number, from 1, that is not taken, for every `n` of `repeats` (path, n).

    With taken numbers t0 < t1 < …, the n-th free one is n plus the number of j with t_j - j <= n. Both are put in one
    order and counted slice by slice, so a path of very many repeats is not one task.
    """
    ordered = running_totals(
        taken.withColumns({"one": F.lit(1).cast("long"), "slice": F.floor(F.col("k") / NUMBERS)}),
        {"rank": "one"},
        ["path"],
        "slice",
        ["k"],
    )
    moves = ordered.select("path", (F.col("k") - F.col("rank") + 1).alias("at"), F.lit(0).alias("asks"), F.lit(1).cast("long").alias("step"))
    asks = repeats.select("path", F.col("n").alias("at"), F.lit(1).alias("asks"), F.lit(0).cast("long").alias("step"))
    both = cut_lineage(moves.unionByName(asks).withColumn("slice", F.floor(F.col("at") / NUMBERS)))
    counted = running_totals(both, {"before": "step"}, ["path"], "slice", ["at", "asks"])
    return counted.filter("asks = 1").select("path", F.col("at").alias("n"), (F.col("at") + F.col("before")).alias("k"))


def assign_paths(df: DataFrame) -> DataFrame:
    """Collision-free storage paths: repeats of a path get `_1`, `_2`, … before the extension.

    Repeats are numbered in URL-key order and take the numbers that are free: a
    numbered path that is some other URL's own path is left to that URL. Two
    paths never give the same numbered path, as it tells its path and number.
    The leading digits of the key cut a path's URLs into even slices in that
    order, so a path shared by a third of the table is numbered slice by slice
    rather than in one task.
    """
    keyed = df.withColumns({"path": U.layout_path(F.col("url")), "key": U.url_key(F.col("url"))})
    keyed = keyed.withColumn("slice", F.substring("key", 1, KEY_DIGITS))
    before = Window.partitionBy("path").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("path", "slice")
        .count()
        .select("path", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    )
    in_slice = Window.partitionBy("path", "slice").orderBy("key", "url")
    numbered = keyed.withColumn("n", F.row_number().over(in_slice) - 1).join(offsets, ["path", "slice"])
    numbered = cut_lineage(
        numbered.select(*df.columns, "path", (F.col("n") + F.col("offset")).cast("long").alias("repeat"))
    )
    paths = numbered.select("path").distinct()
    repeats = numbered.filter("repeat > 0").select("path", F.col("repeat").alias("n"))
    free = _free_numbers(repeats, cut_lineage(_taken_numbers(paths))).withColumnRenamed("n", "repeat")
    stem, ext = _stem_and_ext(F.col("path"))
    stored = F.when(F.col("repeat") == 0, F.col("path")).otherwise(
        F.concat(stem, F.lit("_"), F.col("k").cast("string"), ext)
    )
    named = numbered.join(free, ["path", "repeat"], "left")
    return named.select(*df.columns, "path", "repeat", stored.alias("stored_path"))
