"""One query per operator over the given tables. Every query reads whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe.functions import text as T
from pageframe.functions import urls as U
from pageframe.functions.html_tree import explode_rows
from pageframe.operators import frontier as Fr
from pageframe.operators import host_log as H
from pageframe.operators import links as L
from pageframe.operators import pages as P
from pageframe.operators import records as R
from pageframe.operators import signals as G
from pageframe.operators import url_filters as UF
from pageframe.plans import recipes as X
from pageframe.plans.recipes import table
from pageframe.sinks import writers as K
from pageframe.sources import readers as S
from pageframe.sources.checkpoints import run_folder
from pageframe.streaming import events as St

RUN_TS = "2024-02-01 00:00:00"
AS_OF = "2024-01-15 00:00:00"
EXTENSIONS = ["pdf", "md", "png", "gz"]
KEYWORDS = ["ation", "qu[ae]", "sch", 7]
BREAKER = {"threshold": 3, "cooldown_seconds": 1800.0}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def corpus(spark, sf_dir) -> DataFrame:
    return S.read_pages(spark, f"{sf_dir}/pages.parquet")


def parsed_corpus(spark, sf_dir) -> DataFrame:
    return P.parse_pages(corpus(spark, sf_dir))


def entries(df: DataFrame, col: str) -> DataFrame:
    """One row per entry of a map column."""
    pairs = explode_rows(df, ["page_id"], F.map_entries(col), "entry")
    return pairs.select("page_id", "entry.key", "entry.value")


def joined(col, sep: str = "|"):
    return F.array_join(col, sep)


# --- sources --------------------------------------------------------------------


@query
def page_scan(spark, sf_dir):
    return corpus(spark, sf_dir).select("page_id", "url", F.length("html").alias("n_chars"))


@query
def line_list(spark, sf_dir):
    return S.lines_of(table(spark, sf_dir, "documents"), "text", ".").groupBy("line").agg(F.count("*").alias("n"))


@query
def artifact_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return S.with_digest(docs).select("doc_id", "sha256", "bytes")


@query
def event_scan(spark, sf_dir):
    folder = run_folder(spark, "event_scan")
    K.write_events(X.crawl_events(spark, sf_dir).drop("event_id"), folder)
    return S.read_events(spark, folder).select(
        F.unix_micros("ts").alias("ts_us"), "event", "url", "status", "retries", "bytes", "sha256"
    )


@query
def charset_decode(spark, sf_dir):
    decoded = S.decode_pages(X.stored_bytes(spark, sf_dir))
    return decoded.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


# --- pages ----------------------------------------------------------------------


@query
def nodes_tag_counts(spark, sf_dir):
    return P.to_nodes(parsed_corpus(spark, sf_dir)).groupBy("tag").agg(F.count("*").alias("n"))


@query
def page_title(spark, sf_dir):
    return P.titles(parsed_corpus(spark, sf_dir))


@query
def page_text(spark, sf_dir):
    text = P.page_text(parsed_corpus(spark, sf_dir))
    return text.select("page_id", F.trim(T.collapse_spaces(F.col("text"))).alias("text"))


@query
def clean_text(spark, sf_dir):
    return S.spread(corpus(spark, sf_dir)).select("page_id", T.clean_text(F.col("html")).alias("text"))


@query
def headings(spark, sf_dir):
    levels = entries(P.headings(P.parse_pages(X.doc_pages(spark, sf_dir))), "headings")
    return levels.select("page_id", F.col("key").alias("level"), F.posexplode("value").alias("pos", "heading"))


@query
def meta_map(spark, sf_dir):
    return entries(P.meta_map(P.parse_pages(X.meta_pages(spark, sf_dir))), "metadata")


@query
def open_graph(spark, sf_dir):
    return entries(P.open_graph(P.parse_pages(X.meta_pages(spark, sf_dir))), "open_graph")


@query
def twitter_card(spark, sf_dir):
    return entries(P.twitter_card(P.parse_pages(X.meta_pages(spark, sf_dir))), "twitter_card")


@query
def json_ld(spark, sf_dir):
    found = P.json_ld(P.parse_pages(X.meta_pages(spark, sf_dir)))
    found = explode_rows(found, ["page_id"], F.col("json_ld"), "j")
    return found.select(
        "page_id",
        F.get_json_object("j", "$.name").alias("name"),
        F.get_json_object("j", "$.id").cast("bigint").alias("id"),
    )


@query
def products(spark, sf_dir):
    found = P.products(P.parse_pages(X.product_pages(spark, sf_dir)))
    price = F.col("price_num").cast("bigint").alias("price_num")
    return found.select("page_id", "card_no", *P.PRODUCT_FIELDS, "source_url", price)


@query
def html_tables(spark, sf_dir):
    found = P.html_tables(P.parse_pages(X.order_tables(spark, sf_dir)))
    return found.select(
        "page_id",
        joined("headers").alias("headers"),
        joined("header_row").alias("header_row"),
        joined(F.transform("rows", lambda row: joined(row)), "/").alias("rows"),
    )


@query
def table_cells(spark, sf_dir):
    return P.table_cells(P.parse_pages(X.order_tables(spark, sf_dir)))


@query
def structured_data(spark, sf_dir):
    found = P.structured_data(P.parse_pages(X.meta_pages(spark, sf_dir)))
    return found.select(
        "page_id",
        F.size("json_ld").alias("n_json_ld"),
        F.size("open_graph").alias("n_open_graph"),
        F.size("twitter_card").alias("n_twitter_card"),
        F.col("products")[0]["title"].alias("product_title"),
        F.col("tables")[0]["headers"][0].alias("first_cell"),
    )


@query
def main_markdown(spark, sf_dir):
    return P.main_markdown(P.parse_pages(X.doc_pages(spark, sf_dir)))


def records_of(pages: DataFrame) -> DataFrame:
    return R.page_records(pages, RUN_TS, keywords=KEYWORDS, find_apis=True)


@query
def page_records(spark, sf_dir):
    return records_of(corpus(spark, sf_dir)).select(
        "page_id",
        "url",
        "title",
        "text",
        joined("keywords").alias("keywords"),
        joined("links").alias("links"),
        F.size("metadata").alias("n_metadata"),
        joined(F.col("headings")["h1"]).alias("h1"),
        F.size("api_endpoints").alias("n_apis"),
        *[F.coalesce(F.size(f"structured.{part}"), F.lit(0)).alias(f"n_{part}") for part in ("json_ld", "products", "tables")],
    )


@query
def record_structure(spark, sf_dir):
    return records_of(X.meta_pages(spark, sf_dir)).select(
        "page_id",
        "title",
        F.size("metadata").alias("n_metadata"),
        F.substr(F.col("metadata")["description"], F.lit(7)).alias("description"),
        F.size("structured.json_ld").alias("n_json_ld"),
        F.col("structured.open_graph")["og:locality"].alias("locality"),
        F.col("structured.products")[0]["title"].alias("product_title"),
        F.col("structured.tables")[0]["headers"][0].alias("first_cell"),
    )


@query
def keyword_matches(spark, sf_dir):
    found = T.keyword_matches(F.col("text"), KEYWORDS)
    docs = S.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", joined(found).alias("keywords"))


def responses(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        f"{X.DOC_URL} AS url",
        "timestamp_seconds(doc_id) AS ts",
        f"{X.DOC_TYPE} AS content_type",
        "encode(text, 'UTF-8') AS content",
    )


@query
def binary_split(spark, sf_dir):
    binary, rest = P.split_binary(responses(spark, sf_dir))
    return binary.select("url", "type", "content_type", "size").unionByName(
        rest.selectExpr("url", "'html' AS type", "content_type", "0L AS size")
    )


def file_responses(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        f"{X.BARE_URL} AS url",
        "timestamp_seconds(doc_id) AS ts",
        f"{X.DOC_TYPE} AS content_type",
        "encode('<title>T ' || doc_id || ' &amp; more</title>' || text, 'UTF-8') AS content",
    )


@query
def discovered_files(spark, sf_dir):
    found = R.discovered_files(file_responses(spark, sf_dir), ["pdf"])
    every = R.discovered_files(file_responses(spark, sf_dir), dump_all=True)
    both = found.withColumn("wanted", F.lit("pdf")).unionByName(every.withColumn("wanted", F.lit("all")))
    return both.withColumn("ts_us", F.unix_micros("ts")).drop("ts")


@query
def script_join(spark, sf_dir):
    scripts = L.links(P.parse_pages(X.link_pages(spark, sf_dir)), ["script"])
    bodies = table(spark, sf_dir, "documents").selectExpr(f"'{X.SITE}/x/script/' || doc_id AS url", "text")
    found = R.script_bodies(scripts, bodies)
    return found.select("url", "n_pages", "first_page_id", F.length("text").alias("n_chars"))


@query
def script_scan(spark, sf_dir):
    scripts = L.links(P.parse_pages(X.link_pages(spark, sf_dir)), ["script"])
    bodies = table(spark, sf_dir, "orders").selectExpr(
        f"'{X.SITE}/x/script/' || o_orderkey AS url", f"{X.API_TEXT} AS text"
    )
    return R.script_api_paths(scripts, bodies)


@query
def download_candidates(spark, sf_dir):
    return R.download_candidates(P.parse_pages(X.download_pages(spark, sf_dir)), ["pdf"])


@query
def inline_payloads(spark, sf_dir):
    found = R.inline_payloads(P.parse_pages(X.payload_pages(spark, sf_dir)))
    return found.select("page_id", "file_name", F.md5("content").alias("content_md5"), F.length("uri").alias("uri_chars"))


@query
def next_page(spark, sf_dir):
    return P.parse_pages(X.next_pages(spark, sf_dir)).select("page_id", P.next_page_col(F.col("tree")).alias("href"))


# --- links ----------------------------------------------------------------------


@query
def links_resolved(spark, sf_dir):
    return L.page_links(P.parse_pages(X.relative_pages(spark, sf_dir))).select("page_id", "url")


@query
def links_anchor(spark, sf_dir):
    return L.links(parsed_corpus(spark, sf_dir), ["anchor"]).select("page_id", "url")


def _links_of_kind(kind: str) -> Query:
    def links_of_kind(spark, sf_dir):
        return L.links(P.parse_pages(X.link_pages(spark, sf_dir)), [kind]).select("page_id", "link_kind", "url")

    return links_of_kind


LINK_QUERIES = {
    "links_onclick": "onclick",
    "links_data_attr": "data_attr",
    "links_linktag": "link_tag",
    "links_iframe": "iframe",
    "links_srcset": "srcset",
    "links_img": "img",
    "links_script": "script",
    "links_media": "media",
    "links_refresh": "refresh",
    "links_base": "base",
    "links_inline_js": "inline_js",
}
for _name, _kind in LINK_QUERIES.items():
    QUERIES[_name] = _links_of_kind(_kind)


@query
def links_all(spark, sf_dir):
    return L.links(P.parse_pages(X.link_pages(spark, sf_dir))).select("page_id", "link_kind", "url")


# --- URL filters ----------------------------------------------------------------


@query
def url_parts(spark, sf_dir):
    return UF.with_url_parts(table(spark, sf_dir, "pages").select("page_id", "url"))


@query
def crawlable_links(spark, sf_dir):
    visited = X.part_urls(spark, sf_dir).filter("url LIKE '%.html'").select("url")
    kept = UF.crawlable(X.part_urls(spark, sf_dir), "h1.example.com", ["/d1/", "/d2/", "/f3"], [".js"], visited)
    return kept.select("page_id", "url")


@query
def valid_urls(spark, sf_dir):
    visited = X.part_urls(spark, sf_dir).filter("url LIKE '%/f3%'").select("url")
    kept = UF.valid_urls(X.part_urls(spark, sf_dir), "h3.example.com", "/d2", ["png", "zip"], visited=visited)
    return kept.select("page_id", "url")


@query
def downloadable_links(spark, sf_dir):
    return UF.downloadable(X.part_urls(spark, sf_dir), EXTENSIONS, ["png"])


def bare_urls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{X.BARE_URL} AS url", f"{X.DOC_TYPE} AS content_type")


@query
def mime_ext_join(spark, sf_dir):
    found = UF.mime_ext(bare_urls(spark, sf_dir), ["pdf", "png", "txt"])
    return found.select("doc_id", "url", "mime_ext", "is_file")


@query
def target_files(spark, sf_dir):
    files = UF.target_files(X.part_urls(spark, sf_dir), EXTENSIONS).selectExpr(
        "page_id", "url", "true AS has_targets", "1L AS n_targets"
    )
    blocks = X.part_urls(spark, sf_dir).withColumn("page_id", F.floor(F.col("page_id") / 3))
    flags = UF.pages_with_targets(blocks, EXTENSIONS).withColumn("url", F.lit(""))
    return files.unionByName(flags)


@query
def ext_category_counts(spark, sf_dir):
    tagged = UF.ext_category(X.part_urls(spark, sf_dir))
    return tagged.groupBy("ext", "category").agg(F.count("*").alias("n"))


@query
def display_url(spark, sf_dir):
    urls = table(spark, sf_dir, "pages")
    start = "http://spam-farm.example.org/en/"
    return urls.select("page_id", U.display_url(F.col("url"), start).alias("shown"))


@query
def site_folder(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.site_folder(F.col("url")).alias("folder"))


@query
def artifact_names(spark, sf_dir):
    named = bare_urls(spark, sf_dir).withColumn(
        "disposition", F.expr("case when doc_id % 5 = 0 then 'attachment; filename=\"My file ' || doc_id || '.mdc\"' end")
    )
    name = U.artifact_name(F.col("url"), F.col("content_type"), F.col("disposition"))
    return named.select("doc_id", name.alias("name"))


@query
def artifact_paths(spark, sf_dir):
    urls = X.part_urls(spark, sf_dir).select("url")
    numbered = urls.filter("url LIKE '%/f%.html'").selectExpr("replace(url, '.html', '_1.html') AS url")
    return UF.assign_paths(urls.unionByName(numbered).distinct()).select("url", "stored_path")


@query
def url_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.url_key(F.col("url")).alias("key"))


# --- signals --------------------------------------------------------------------


@query
def api_paths(spark, sf_dir):
    return G.api_paths(X.api_pages(spark, sf_dir))


@query
def secret_findings(spark, sf_dir):
    return G.secret_findings(table(spark, sf_dir, "documents"))


@query
def redact_secrets(spark, sf_dir):
    redacted = G.redact_secrets(table(spark, sf_dir, "documents"))
    return redacted.select("doc_id", F.md5("text").alias("text_md5"))


@query
def render_class(spark, sf_dir):
    pages = X.render_pages(spark, sf_dir).unionByName(
        X.shell_pages(spark, sf_dir).withColumn("page_id", -F.col("page_id") - 1)
    )
    return G.render_class(P.parse_pages(pages, "html"))


@query
def dynamic_score(spark, sf_dir):
    pages = X.render_pages(spark, sf_dir)
    targets = pages.select("page_id", (F.col("page_id") % 16 == 5).alias("has_targets"))
    return G.dynamic_score(pages, targets)


@query
def challenge_pages(spark, sf_dir):
    flagged = G.challenge_pages(X.render_pages(spark, sf_dir), browser_check=True)
    return flagged.select("page_id", "is_challenge")


# --- dataflow -------------------------------------------------------------------


@query
def visited_dedup(spark, sf_dir):
    seen = X.part_urls(spark, sf_dir).selectExpr("url", "page_id % 4 AS depth")
    return Fr.dedup_urls(seen)


@query
def crawl_frontier(spark, sf_dir):
    seeds = spark.createDataFrame([("/p/1",)], "url string")
    return Fr.crawl_frontier(X.crawl_edges(spark, sf_dir), seeds, max_depth=4, exclude=["/p/13"])


@query
def route_links(spark, sf_dir):
    links = X.part_urls(spark, sf_dir).selectExpr("floor(page_id / 25) AS page_id", "url", "page_id % 5 AS depth")
    return Fr.route_links(links, 3, EXTENSIONS, exclude=["/d1/"])


@query
def download_dedup(spark, sf_dir):
    asked = X.part_urls(spark, sf_dir).selectExpr("url", "page_id AS seq")
    return Fr.mark_duplicates(asked).select("seq", "url", "status")


@query
def ordered_distinct(spark, sf_dir):
    links = X.part_urls(spark, sf_dir).selectExpr("floor(page_id / 500) AS page_id", "url", "page_id AS pos")
    return Fr.ordered_distinct(links, ["page_id"], "url", "pos")


@query
def keep_newest(spark, sf_dir):
    log = X.fetch_log(spark, sf_dir)
    by_first = Fr.keep_newest(log, 100, "url", "ts").withColumn("kept_by", F.lit("first"))
    by_last = Fr.keep_newest(log, 100, "url", "ts", touch=True).withColumn("kept_by", F.lit("last"))
    return by_first.unionByName(by_last).select("url", "kept_by", F.unix_micros("seen").alias("seen_us"))


@query
def union_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS page_id", "lang")
    return Fr.collect_pages(pages, docs)


@query
def first_match(spark, sf_dir):
    hits = X.part_urls(spark, sf_dir).selectExpr(
        "floor(page_id / 10) AS page_id", "page_id % 3 AS rank", "page_id AS node_id", "url"
    )
    return Fr.first_match(hits, ["page_id"], "rank", "node_id", "url")


@query
def needs_render(spark, sf_dir):
    links = X.part_urls(spark, sf_dir).withColumn("page_id", F.floor(F.col("page_id") / 2))
    pages = links.select("page_id").distinct()
    return Fr.needs_render_pages(pages, links, ["pdf", "md"])


@query
def clean_endpoints(spark, sf_dir):
    return Fr.clean_endpoints(X.endpoint_lines(spark, sf_dir)).select("endpoint", "kind")


@query
def top_k_latency(spark, sf_dir):
    log = X.fetch_log(spark, sf_dir).select("event_id", "host", F.round("rt", 6).alias("rt"))
    return Fr.top_k(log, 50, "rt", tie="event_id")


@query
def top_hosts(spark, sf_dir):
    scores = H.host_healthy(X.fetch_log(spark, sf_dir), AS_OF, min_score=-1e9)
    best = Fr.top_k(scores.filter("healthy"), 3, "health", ascending=False, tie="host")
    return best.select("host", F.round("health", 6).alias("health"))


# --- reports --------------------------------------------------------------------


@query
def file_inventory(spark, sf_dir):
    files = table(spark, sf_dir, "documents").selectExpr(f"{X.DOC_TYPE} AS content_type", "n_chars AS size")
    return R.file_inventory(files).select(
        F.coalesce("content_type", F.lit("(all)")).alias("content_type"), "files", "bytes"
    )


@query
def discovery_summary(spark, sf_dir):
    api = G.api_paths(X.api_pages(spark, sf_dir))
    return R.discovery_summary(api, G.secret_findings(table(spark, sf_dir, "documents")))


@query
def crawl_summary(spark, sf_dir):
    return R.crawl_summary(X.crawl_events(spark, sf_dir))


@query
def flat_pages(spark, sf_dir):
    flat = R.flat_pages(records_of(corpus(spark, sf_dir)))
    return flat.select("url", "title", "text", "keywords", "num_links", "api_endpoints")


@query
def flat_binaries(spark, sf_dir):
    binary, _ = P.split_binary(responses(spark, sf_dir))
    return R.flat_binaries(binary).select("url", F.unix_micros("ts").alias("ts_us"), "type", "size")


@query
def progress(spark, sf_dir):
    events = X.crawl_events(spark, sf_dir).select("event_id", "ts", "event", "status", "url")
    queued = events.filter("event = 'fetch_start'").selectExpr("event_id", "ts - interval 5 hours", "'enqueue'", "status", "url")
    apis = events.filter("event = 'retry'").selectExpr("event_id", "ts", "'api_found'", "status", "url")
    report = R.progress(events.union(queued).union(apis))
    return report.withColumn("until", F.unix_micros("until")).withColumnRenamed("until", "until_us")


# --- host log -------------------------------------------------------------------


@query
def retryable(spark, sf_dir):
    return H.retryable(X.fetch_log(spark, sf_dir)).select("event_id", "host", "status")


@query
def retry_plan(spark, sf_dir):
    log = X.fetch_log(spark, sf_dir).selectExpr(
        "*",
        "event_id % 12 AS attempt",
        "case event_id % 4 when 0 then '7' when 1 then '900' when 2 then 'soon' end AS retry_after",
    )
    plan = H.retry_plan(log, 250, "fibonacci")
    linear = H.strategy_delay_ms(F.col("attempt"), 7000, "linear").cast("bigint").alias("linear_ms")
    return plan.select(
        "event_id",
        "delay_ms",
        "jitter_bound_ms",
        F.col("strategy_ms").alias("fibonacci_ms"),
        linear,
        F.unix_micros("retry_at").alias("retry_at_us"),
    )


@query
def host_totals(spark, sf_dir):
    totals = H.host_totals(X.fetch_log(spark, sf_dir))
    return totals.withColumn("success_rate", F.round("success_rate", 6))


@query
def host_ewma(spark, sf_dir):
    return H.host_ewma(X.fetch_log(spark, sf_dir)).select("host", F.round("ewma", 6).alias("ewma"))


@query
def host_streaks(spark, sf_dir):
    streaks = H.host_streaks(X.fetch_log(spark, sf_dir))
    return streaks.withColumn("last_failure", F.unix_micros("last_failure"))


@query
def host_marked(spark, sf_dir):
    return H.host_marked(X.fetch_log(spark, sf_dir), max_streak=6, max_failures=220)


@query
def host_health(spark, sf_dir):
    return H.host_health(X.fetch_log(spark, sf_dir)).select("event_id", "host", F.round("health", 6).alias("health"))


@query
def host_healthy(spark, sf_dir):
    verdict = H.host_healthy(X.fetch_log(spark, sf_dir), AS_OF, min_score=-300.0, max_streak=2, recovery_seconds=40_000)
    return verdict.withColumn("health", F.round("health", 6))


@query
def host_healthy_at(spark, sf_dir):
    """The verdict on every host of a day at the end of each of its hours."""
    log = X.fetch_log(spark, sf_dir)
    instants = log.selectExpr("host", "date_trunc('hour', ts) + interval 1 hour AS at").distinct()
    verdict = H.host_healthy_at(log, instants, min_score=-300.0, max_streak=2, recovery_seconds=40_000)
    return verdict.select("host", F.unix_micros("at").alias("at_us"), F.round("health", 6).alias("health"), "current_streak", "healthy")


@query
def host_rank(spark, sf_dir):
    return H.host_rank(X.fetch_log(spark, sf_dir), AS_OF)


@query
def breaker_timeline(spark, sf_dir):
    return H.breaker_timeline(X.fetch_log(spark, sf_dir), **BREAKER)


@query
def host_delay(spark, sf_dir):
    return H.host_delay(X.fetch_log(spark, sf_dir)).select("host", F.round("delay", 6).alias("delay"))


@query
def cooldown(spark, sf_dir):
    return H.cooldown_violations(X.fetch_log(spark, sf_dir), 300.0).select("event_id", "host", "gap_us")


# --- streams --------------------------------------------------------------------

STREAM_EVENT_DDL = f"event_id long, {S.EVENT_DDL}"


def stored_events(spark, sf_dir) -> str:
    """The events as a folder of NDJSON files."""
    folder = run_folder(spark, "events")
    K.write_events(X.crawl_events(spark, sf_dir), folder)
    return folder


def event_stream(spark, sf_dir) -> DataFrame:
    return spark.readStream.schema(STREAM_EVENT_DDL).json(stored_events(spark, sf_dir))


def finished(spark, stream: DataFrame, name: str) -> DataFrame:
    """Rows of a stream after it has taken in everything there is."""
    folder = run_folder(spark, name)
    St.run_available(St.write_stream(stream, folder, "parquet"))
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def latest(spark, stream: DataFrame, keys: list[str], name: str, mode: str = "update") -> DataFrame:
    """The newest version of every row of a stream that updates rows, after it has taken in everything there is."""
    folder = run_folder(spark, name)
    St.run_available(St.write_versions(stream, folder, mode))
    return St.read_versions(spark, folder, stream.schema, keys, mode)


@query
def stream_ingest(spark, sf_dir):
    folder = run_folder(spark, "events")
    events = X.crawl_events(spark, sf_dir)
    K.write_events(events.unionByName(events.filter("event_id % 3 = 0")), folder)
    stream = St.stream_events(spark, folder, ["event_id"], STREAM_EVENT_DDL)
    rows = finished(spark, stream, "stream_ingest")
    return rows.select("event_id", F.unix_micros("ts").alias("ts_us"), "event", "url")


def window_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "event", "n")


@query
def stream_progress(spark, sf_dir):
    counts = St.stream_progress(event_stream(spark, sf_dir), "1 hour")
    return window_rows(latest(spark, counts, ["start", "event"], "stream_progress"))


@query
def stream_progress_sliding(spark, sf_dir):
    counts = St.stream_progress(event_stream(spark, sf_dir), "2 hours", "1 hour")
    return window_rows(latest(spark, counts, ["start", "event"], "stream_sliding"))


@query
def stream_sessions(spark, sf_dir):
    sessions = St.stream_sessions(event_stream(spark, sf_dir), "url", 6 * 3600)
    rows = latest(spark, sessions, ["url", "start"], "stream_sessions").filter("n > 0")
    return rows.select("url", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query
def stream_enrich(spark, sf_dir):
    downloads = X.crawl_events(spark, sf_dir).filter("event = 'download_complete'")
    lines = downloads.filter("event_id % 500 % 2 = 0").selectExpr(  # odd pages are not in the manifest
        "url", "ts + make_dt_interval(0, 0, event_id % 40) AS ts", "'files/' || md5(url) AS path", "'text/html' AS content_type"
    )
    folder = run_folder(spark, "manifest")
    K.write_events(lines, folder)
    manifest = spark.readStream.schema("url string, ts timestamp, path string, content_type string").json(folder)
    events = stored_events(spark, sf_dir)
    enriched = St.stream_enrich(spark.readStream.schema(STREAM_EVENT_DDL).json(events), manifest, after="30 minutes")
    told = finished(spark, enriched, "stream_enrich")
    rest = St.enrich_rest(spark.read.schema(STREAM_EVENT_DDL).json(events), told)
    return told.unionByName(rest).select("event_id", "url", "status", "path", "content_type")


@query
def stream_breaker(spark, sf_dir):
    folder = run_folder(spark, "fetch_log")
    K.write_events(X.fetch_log(spark, sf_dir), folder)
    ddl = "event_id long, ts timestamp, host string, ok boolean"
    log = spark.readStream.schema(ddl).json(folder)
    closed = finished(spark, St.stream_breaker(log, late="0 seconds", **BREAKER), "stream_breaker")
    rest = St.breaker_rest(spark.read.schema(ddl).json(folder), late="0 seconds", **BREAKER)
    return closed.unionByName(rest)


@query
def stream_event_sink(spark, sf_dir):
    folder = run_folder(spark, "stream_sink")
    St.run_available(St.write_events_stream(event_stream(spark, sf_dir), folder))
    manifest = S.read_manifest(spark, f"{folder}/manifest")
    return manifest.select("url", "path", "sha256", "bytes")


# --- sinks ----------------------------------------------------------------------


@query
def sink_json(spark, sf_dir):
    folder = run_folder(spark, "sink_json")
    records = records_of(corpus(spark, sf_dir))
    K.write_pages_json(records, folder)
    back = spark.read.schema(records.schema).json(folder)
    return back.select("page_id", "url", "title", F.md5("text").alias("text_md5"), joined("links").alias("links"))


@query
def sink_csv(spark, sf_dir):
    folder = run_folder(spark, "sink_csv")
    K.write_pages_csv(records_of(corpus(spark, sf_dir)), folder)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(folder)
    return back.select("url", "title", "text", F.col("num_links").cast("int").alias("num_links"))


@query
def sink_products(spark, sf_dir):
    folder = run_folder(spark, "sink_products")
    found = P.products(P.parse_pages(X.product_pages(spark, sf_dir)))
    for _ in range(2):
        K.write_products(found, folder, "run1", RUN_TS)
    ddl = ", ".join(f"{c} string" for c in [*K.PRODUCT_COLUMNS, "run_id"])
    as_json = spark.read.schema(ddl).json(f"{folder}/json")
    as_csv = spark.read.schema(ddl).option("header", True).option("escape", '"').csv(f"{folder}/csv")
    both = as_json.unionByName(as_csv)
    return both.groupBy("url", "title", "price", "source_url", "extracted_at", "run_id").agg(F.count("*").alias("copies"))


@query
def sink_tables(spark, sf_dir):
    folder = run_folder(spark, "sink_tables")
    K.write_tables(P.html_tables(P.parse_pages(X.order_tables(spark, sf_dir))), folder, RUN_TS)
    ddl = "source_url string, extracted_at string, page_id long, table_no int, headers array<string>, rows array<array<string>>"
    back = spark.read.schema(ddl).json(folder)
    return back.select("page_id", "source_url", joined("headers").alias("headers"), F.size("rows").alias("n_rows"))


@query
def sink_discoveries(spark, sf_dir):
    folder = run_folder(spark, "sink_discoveries")
    files = R.discovered_files(file_responses(spark, sf_dir), dump_all=True)
    K.write_discoveries(files, G.api_paths(X.api_pages(spark, sf_dir)), folder)
    apis = spark.read.schema("api_url string, n_pages long").json(f"{folder}/endpoints")
    counts = spark.read.schema("content_type string, files long, bytes long").json(f"{folder}/file_counts")
    return apis.selectExpr("api_url AS name", "n_pages AS n", "0L AS bytes").unionByName(
        counts.selectExpr("coalesce(content_type, '(all)') AS name", "files AS n", "bytes")
    )


@query
def sink_manifest(spark, sf_dir):
    folder = run_folder(spark, "sink_manifest")
    K.write_manifest(X.artifacts(spark, sf_dir), folder)
    return S.read_manifest(spark, folder)


@query
def sink_events(spark, sf_dir):
    rows = spark.read.schema(STREAM_EVENT_DDL).json(stored_events(spark, sf_dir))
    return rows.select("event_id", F.unix_micros("ts").alias("ts_us"), "event", "status", "bytes")


@query
def sink_ranked(spark, sf_dir):
    folder = run_folder(spark, "sink_ranked")
    lines = Fr.clean_endpoints(X.endpoint_lines(spark, sf_dir))
    timed = lines.withColumn("seconds", F.col("port") / 1000)
    K.write_ranked(timed, folder)
    return spark.read.text(f"{folder}/detailed").select(F.col("value").alias("line"))


@query
def decode_payloads(spark, sf_dir):
    uris = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            F.lit("blob:doc "),
            F.col("doc_id").cast("string"),
            F.lit(".mdc:"),
            F.base64(F.encode("text", "UTF-8")),
        ).alias("uri"),
    )
    return R.decode_payloads(uris).select("doc_id", "file_name", "sha256", "bytes")


# --- extension ------------------------------------------------------------------


@query
def custom_extractor(spark, sf_dir):
    from pageframe.functions.extractors import register_extractor

    extract = register_extractor(spark, "link_density", count_links, "struct<n_links:int,n_chars:int>")
    found = corpus(spark, sf_dir).select("page_id", extract("html").alias("r"))
    return found.select("page_id", "r.n_links", "r.n_chars")


def count_links(html: pa.Array) -> pa.Array:
    """Links and characters of every page of a batch, by Arrow's own functions."""
    counts = [pc.count_substring(html, "<a "), pc.cast(pc.utf8_length(html), pa.int32())]
    return pa.StructArray.from_arrays(counts, ["n_links", "n_chars"])
