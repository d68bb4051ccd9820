"""Page records, reports, candidates and payloads built from several extractors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.functions import text as T
from pageframe.functions.constants import BINARY_TYPES, DOWNLOAD_WORDS
from pageframe.functions.html_tree import (
    attr,
    explode_rows,
    find_all,
    find_first,
    first,
    has_attr,
    inside,
    is_tag,
    let,
    strip,
    text_of,
)
from pageframe.functions.urls import contains_any, mdc_to_md, path, resolve_one, safe_file_name, url_struct
from pageframe.operators import pages as P
from pageframe.operators.links import links_col
from pageframe.operators.running import running_totals
from pageframe.operators.signals import api_paths, api_urls_col
from pageframe.operators.url_filters import normal_extensions
from pageframe.sources.checkpoints import cut_lineage

# --- page records ---------------------------------------------------------------


def page_records(
    pages: DataFrame,
    run_ts: str,
    keywords: list[str] | None = None,
    find_apis: bool = False,
    clean: bool = True,
    link_kinds: list[str] | None = None,
) -> DataFrame:
    """One record per page: url, ts, title, text, keywords, links, metadata, headings, structured data, API paths.

    A page is parsed once and nothing is shuffled.
    """
    tree = F.col("tree")
    parsed = P.parse_pages(pages.withColumn("base", url_struct(F.col("url"))), "base", "html")
    apis = api_urls_col(F.col("html"), F.col("base")) if find_apis else F.lit(None).cast("array<string>")
    cleaned = parsed.withColumns({"text": T.clean_text(P.page_text_col(tree), clean), "api_endpoints": apis})
    return cleaned.select(
        "page_id",
        "url",
        F.lit(run_ts).cast("timestamp").alias("ts"),
        P.title_col(tree).alias("title"),
        "text",
        T.keyword_matches(F.col("text"), keywords or []).alias("keywords"),
        links_col(tree, F.col("base"), link_kinds or ["anchor"]).alias("links"),
        P.meta_map_col(tree).alias("metadata"),
        P.headings_col(tree).alias("headings"),
        P.structured_col().alias("structured"),
        "api_endpoints",
    )


def flat_pages(records: DataFrame) -> DataFrame:
    """Page records as plain columns for CSV; the text is cut at 1000 characters, as reports show it."""
    return records.select(
        "url",
        "ts",
        "title",
        F.substring("text", 1, 1000).alias("text"),
        F.array_join("keywords", ", ").alias("keywords"),
        F.size("links").alias("num_links"),
        F.coalesce(F.array_join("api_endpoints", ", "), F.lit("")).alias("api_endpoints"),
    )


def flat_binaries(records: DataFrame) -> DataFrame:
    return records.select("url", "ts", "type", "size")


# --- downloads ------------------------------------------------------------------


def download_candidates(parsed: DataFrame, extensions: list[str], words: list[str] = DOWNLOAD_WORDS) -> DataFrame:
    """Download URLs of a page with the strategy that found each first.

    1 text or link suggests a download, 2 attributes and extensions, 4 case-blind search in href.
    (3 is the inline payloads, see `inline_payloads`.)
    """
    tree, base = F.col("tree"), F.col("base")
    exts = [f".{e.lower()}" for e in extensions]

    def says(node):
        return contains_any(F.lower(text_of(tree, node)), words)

    def hit(node):
        href = attr(node, "href")
        clickable = is_tag(node, "a", "button")
        by_text = says(node)
        ends = contains_any(F.concat(F.lower(href), F.lit("\n")), [f"{e}\n" for e in exts])  # with its fragment
        by_attribute = (
            has_attr(node, "download")
            | attr(node, "onclick").contains("download")
            | (is_tag(node, "a") & contains_any(href, exts))
        )
        by_href = clickable & F.lower(href).contains("download")
        return (
            F.when(by_text | (is_tag(node, "a") & ends), 1).when(by_attribute, 2).when(by_href, 4)
        )

    linked = find_all(tree["nodes"], lambda n: F.coalesce(attr(n, "href"), F.lit("")) != "")
    hits = F.transform(
        linked,
        lambda n: F.struct(
            hit(n).alias("strategy"), n["node_id"].alias("node_id"), resolve_one(base, attr(n, "href")).alias("url")
        ),
    )
    hits = F.filter(hits, lambda h: h["strategy"].isNotNull() & h["url"].isNotNull())
    # of a URL the best hit stays: the first of its run in one sort, inside the row, so nothing is shuffled
    by_url = F.transform(hits, lambda h: F.struct(*[h[name].alias(name) for name in ("url", "strategy", "node_id")]))

    def leads(ranked):
        return F.filter(ranked, lambda h, i: (i == 0) | (h["url"] != F.get(ranked, i - 1)["url"]))

    firsts = let(F.array_sort(by_url), leads)
    based = parsed.withColumn("base", url_struct(F.col("url")))
    found = explode_rows(based, ["page_id"], firsts, "h").select("page_id", "h.*")
    return found.select("page_id", "url", "strategy", F.col("node_id").alias("position"))


# Where script code names a file and holds its content, best first.
FILE_NAME_PATTERNS = [
    r"download\s*=\s*['\"]([^'\"]+)['\"]",
    r"\.download\s*=\s*['\"]([^'\"]+)['\"]",
    r"setAttribute\s*\(\s*['\"]download['\"],\s*['\"]([^'\"]+)['\"]",
    r"filename['\"]?\s*[:=]\s*['\"]([^'\"]+)['\"]",
]
CONTENT_PATTERNS = [
    r"textContent\s*[=:]\s*['\"]([^'\"]+)['\"]",
    r"innerText\s*[=:]\s*['\"]([^'\"]+)['\"]",
    r"content\s*[=:]\s*['\"]([^'\"]+)['\"]",
    r"data\s*[=:]\s*['\"]([^'\"]+)['\"]",
]
DEFAULT_FILE_NAME = "downloaded_file.txt"


def _captured(code: Column, patterns: list[str], flags: str) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(code, f"({flags}){p}", 1), F.lit("")) for p in patterns])


def _nearby_text(tree: Column, node: Column, tagged: Column, with_own: bool) -> Column:
    """Text of a node of a tag near another: below earlier siblings, later siblings, parent, grandparent, itself.

    `tagged` are the page's nodes of that tag in document order. What is below earlier siblings stands between the
    parent and the node, and what is below later ones behind the node, up to the parent's end.
    """
    nodes = tree["nodes"]

    def below(outer):
        return find_first(tagged, lambda n: inside(n, outer))

    parent = F.get(nodes, F.when(node["parent_id"] >= 0, node["parent_id"]))
    grandparent = F.get(nodes, F.when(parent["parent_id"] >= 0, parent["parent_id"]))
    end = F.coalesce(parent["end_id"], F.size(nodes))

    def below_siblings(low, high):
        return find_first(
            tagged, lambda n: (n["node_id"] > low) & (n["node_id"] <= high) & (n["parent_id"] != node["parent_id"])
        )

    places = [
        below_siblings(node["parent_id"], node["node_id"] - 1),
        below_siblings(node["end_id"], end),
        below(parent),
        below(grandparent),
    ] + ([below(node)] if with_own else [])
    texts = [let(text_of(tree, place), lambda t: F.when(strip(t) != "", t)) for place in places]
    return F.coalesce(*texts)


def _payload(tree: Column, url: Column, node: Column, lists: Column) -> Column:
    code = F.coalesce(
        *[F.nullif(attr(node, name), F.lit("")) for name in ("@click", "onclick", "x-on:click", "data-action")]
    )
    words = F.split(strip(text_of(tree, node)), r"[\s\p{Z}]+")
    dotted = first(
        F.filter(words, lambda w: w.contains(".") & (F.length(F.substring_index(w, ".", -1)) <= 5))
    )
    name = F.coalesce(
        _captured(code, FILE_NAME_PATTERNS, "?i"),
        F.nullif(F.btrim(dotted, F.lit(".,!?;:")), F.lit("")),
        F.lit(DEFAULT_FILE_NAME),
    )
    ref_name = F.regexp_extract(code, r"\$refs\.([\p{L}\p{N}_]+)", 1)
    referenced = F.when(ref_name != "", find_first(lists["named"], lambda n: attr(n, "x-ref") == ref_name))
    content = F.coalesce(
        _nearby_text(tree, node, lists["code"], with_own=True),
        _nearby_text(tree, node, lists["pre"], with_own=False),
        _captured(code, CONTENT_PATTERNS, "?is"),
        F.nullif(text_of(tree, referenced), F.lit("")),
        F.concat(F.lit("# "), name, F.lit("\n\nNo content was found for this file on "), url),
    )
    return F.struct(node["node_id"].alias("node_id"), name.alias("file_name"), content.alias("content"))


def inline_payloads(parsed: DataFrame) -> DataFrame:
    """Files a page builds in script code: name, content and `blob:name:base64` URI."""
    tree = F.col("tree")

    def builds_file(node):
        code = F.coalesce(
            *[F.nullif(attr(node, a), F.lit("")) for a in ("onclick", "@click", "x-on:click")], F.lit("")
        )
        marked = has_attr(node, "onclick") | has_attr(node, "x-on:click")
        return marked & F.lower(code).rlike("blob|download")

    def kept(matches):
        return find_all(tree["nodes"], matches)

    # Lists of the nodes that are looked for, made once a page, so a button does not search all of them.
    lists = F.struct(
        kept(lambda n: is_tag(n, "code")).alias("code"),
        kept(lambda n: is_tag(n, "pre")).alias("pre"),
        kept(lambda n: has_attr(n, "x-ref")).alias("named"),
    )
    payloads = let(lists, lambda own: F.transform(kept(builds_file), lambda n: _payload(tree, F.col("url"), n, own)))
    found = explode_rows(parsed, ["page_id"], payloads, "p").select("page_id", "p.*")
    uri = F.concat(F.lit("blob:"), "file_name", F.lit(":"), F.base64(F.encode("content", "UTF-8")))
    return found.withColumn("uri", F.replace(uri, F.lit("\r\n"), F.lit("")))


def decode_payloads(df: DataFrame, col: str = "uri") -> DataFrame:
    """Artifacts of `blob:name:base64` URIs."""
    parts = F.split(F.col(col), ":", 3)
    name = safe_file_name(mdc_to_md(parts[1]))
    return df.withColumns(
        {
            "file_name": F.when(name == "", "downloaded_file.md").otherwise(name),
            "content": F.try_to_binary(parts[2], F.lit("base64")),
        }
    ).withColumns({"sha256": F.sha2("content", 256), "bytes": F.octet_length("content").cast("long")})


# --- discovered files -----------------------------------------------------------


def discovered_files(responses: DataFrame, extensions: list[str] | None = None, dump_all: bool = False) -> DataFrame:
    """Wanted files among responses (url, ts, content_type, content): url, path, content_type, size, ts, title, type.

    A response is wanted if its whole URL ends with one of the extensions, or with `dump_all`. Binary ones have no
    title; of html ones it is read from the content.
    """
    url = F.lower("url")
    wanted = F.lit(dump_all)
    for ext in normal_extensions(extensions):
        wanted = wanted | url.endswith(f".{ext}")
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    binary = contains_any(kind, BINARY_TYPES)
    html = F.when(~binary, F.decode("content", "UTF-8"))
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return responses.filter(wanted).select(
        "url",
        path(F.col("url")).alias("path"),
        kind.alias("content_type"),
        F.octet_length("content").cast("long").alias("size"),
        "ts",
        F.when(~binary, strip(T.unescape(F.coalesce(title, F.lit(""))))).alias("title"),
        F.when(binary, "binary").otherwise("html").alias("type"),
    )


# --- scripts --------------------------------------------------------------------


def script_bodies(script_links: DataFrame, corpus: DataFrame) -> DataFrame:
    """Bodies of the scripts that pages load, each script once, with the number of pages that load it.

    Counting before the join leaves one row per script, however many pages share it. The corpus is first cut down by
    its key column alone, so the side that texts are joined with holds matching scripts only.
    """
    scripts = script_links.groupBy("url").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page_id"))
    known = scripts.join(corpus.select("url").distinct(), "url", "left_semi")
    return known.join(corpus.select("url", "text"), "url")


def script_api_paths(script_links: DataFrame, corpus: DataFrame) -> DataFrame:
    """API paths found in the scripts that pages load, resolved against the script's URL."""
    bodies = script_bodies(script_links, corpus).withColumnRenamed("first_page_id", "page_id")
    return api_paths(bodies, "text")


# --- reports --------------------------------------------------------------------


def file_inventory(files: DataFrame) -> DataFrame:
    """Files and bytes per content type, with a NULL row for the whole."""
    typed = files.withColumn("content_type", F.coalesce("content_type", F.lit("unknown")))
    return typed.rollup("content_type").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def discoveries(api: DataFrame, secrets: DataFrame) -> DataFrame:
    """Distinct findings as rows: kind and value (a hash for secrets)."""
    endpoints = api.select(F.lit("endpoint").alias("kind"), F.col("api_url").alias("value"))
    return endpoints.unionByName(secrets.select(F.lit("secret").alias("kind"), F.col("sha256").alias("value"))).distinct()


def discovery_summary(api: DataFrame, secrets: DataFrame) -> DataFrame:
    """Distinct findings per kind, zero included."""
    found = discoveries(api, secrets).agg(
        *[F.count_if(F.col("kind") == kind).alias(kind) for kind in ("endpoint", "secret")]
    )
    return found.unpivot([], ["endpoint", "secret"], "kind", "total")


def crawl_summary(events: DataFrame) -> DataFrame:
    """Distinct URLs visited, and files found and downloaded, from an event log."""

    event = F.col("event")
    flags = {
        "visited": event == "fetch_start",
        "discovered": event.isin("download_start", "download_complete"),
        "downloaded": (event == "download_complete") & (F.col("status") == "ok"),
    }
    by_url = events.filter("url is not null").groupBy("url").agg(*[F.bool_or(test).alias(n) for n, test in flags.items()])
    return by_url.agg(*[F.count_if(name).alias(name) for name in flags])


def progress(events: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Counts of visited, failed, active and queued fetches, files and APIs so far, at the end of each time bucket.

    Visited are distinct URLs: each counts from the first start of its fetch. A URL is queued from its `enqueue` event
    until its fetch starts. Events are counted per bucket first; running sums go over the buckets, day by day.
    """
    event = F.col("event")
    firsts = events.filter(event == "fetch_start").groupBy("url").agg(F.min("ts").alias("ts"))
    marked = events.select("ts", "event", "status").unionByName(firsts.select("ts", F.lit("first_start").alias("event")), allowMissingColumns=True)
    counted = marked.groupBy(F.window("ts", bucket)["end"].alias("until")).agg(
        F.count_if(event == "first_start").alias("visited"),
        F.count_if(event == "fetch_start").alias("started"),
        F.count_if(event == "fetch_ok").alias("ok"),
        F.count_if(event == "fetch_fail").alias("failed"),
        F.count_if((event == "download_complete") & (F.col("status") == "ok")).alias("files"),
        F.count_if(event == "enqueue").alias("enqueued"),
        F.count_if(event == "api_found").alias("apis"),
    )
    # one row per bucket: stored, as the running sums read it twice
    counted = cut_lineage(counted).withColumn("day", F.to_date("until"))
    names = ("visited", "started", "ok", "failed", "files", "enqueued", "apis")
    out = running_totals(counted, {f"{name}_so_far": name for name in names}, [], "day", ["until"])
    active = F.col("started_so_far") - F.col("ok_so_far") - F.col("failed_so_far")
    return out.select(
        "until",
        F.col("visited_so_far").alias("visited"),
        F.col("failed_so_far").alias("failed"),
        active.alias("active"),
        F.greatest(F.lit(0), F.col("enqueued_so_far") - F.col("started_so_far")).alias("queued"),
        F.col("files_so_far").alias("files"),
        F.col("apis_so_far").alias("apis"),
    )
