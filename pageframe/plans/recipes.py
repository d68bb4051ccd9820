"""Inputs with a known answer, rendered by Spark from the given tables.

Texts that both engines read the same way are kept as SQL expressions, so the
expected results can be computed from the tables alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe.sources.readers import spread_keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of part, dealt out for pages to be rendered from."""
    return spread_keys(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


# --- SQL expressions shared by both engines -------------------------------------

SITE = "https://w.example.com"

# over events
HOST = "'host' || (user_id % 20) || '.example.com'"
LOG_URL = f"'https://' || {HOST} || '/p/' || (event_id % 500)"
LOG_STATUS = (
    "case when event_type = 'error' and event_id % 5 = 0 then 504 when event_type = 'error' then 503 "
    "when event_type = 'signup' then 429 else 200 end"
)
LOG_OK = "event_type in ('click', 'view', 'purchase')"
EVENT_NAME = (
    "case event_type when 'click' then 'fetch_start' when 'view' then 'fetch_ok' when 'error' then 'fetch_fail' "
    "when 'signup' then 'retry' else 'download_complete' end"
)
EVENT_STATUS = "case when event_type = 'purchase' then case when event_id % 4 = 0 then 'fail' else 'ok' end else 'start' end"

# over part: URLs with many kinds of names, paths repeated over hosts
PART_URL = (
    "(case when p_partkey % 11 = 0 then 'http' else 'https' end) || '://h' || (p_partkey % 5) || '.example.com/d' || "
    "(p_partkey % 7) || '/f' || (p_partkey % 90) || (case p_partkey % 10 when 0 then '.pdf' when 1 then '.html' "
    "when 2 then '' when 3 then '.PNG' when 4 then '.tar.gz' when 5 then '.mdc' when 6 then '/' when 7 then '.js' "
    "when 8 then '?x=a.zip' else '.md#part' end)"
)
# over documents
DOC_URL = "'https://d' || (doc_id % 3) || '.example.com/' || source || '/' || doc_id"
DOC_TYPE = (
    "case doc_id % 8 when 0 then 'image/png' when 1 then 'application/pdf' when 2 then 'application/octet-stream' "
    "when 3 then 'text/html; charset=utf-8' when 4 then 'video/mp4' when 5 then 'text/plain' "
    "when 6 then 'application/zip' else null end"
)
BARE_URL = (
    "'https://d.example.com/' || (case doc_id % 4 when 0 then 'download' when 1 then 'x' when 2 then 'files' "
    "else 'a.pdf' end) || '/' || (case when doc_id % 9 = 0 then 'n.pdf' else 'n' || doc_id end)"
)
# over orders
API_TEXT = (
    "'see ' || (case o_orderkey % 7 when 0 then '/api/v' || (o_orderkey % 4) || '/x' when 1 then '/graphql?q=1' "
    "when 2 then '/rest/items-' || (o_orderkey % 13) || ' and /Login' when 3 then 'nothing here' "
    "when 4 then 'wss://s' || (o_orderkey % 5) || '.example.com/feed now' when 5 then '\"/data/f.json?k=1\"' "
    "else '/users/ or /swagger' end) || (case when o_orderkey % 3 = 0 then ' to /ws' else ' .' end)"
)
API_PAGE = "'https://s' || (o_orderkey % 3) || '.example.com/a/b'"
# over customer
ENDPOINT_LINE = (
    "(case c_custkey % 6 when 0 then 'http://' when 1 then 'https://' when 2 then 'socks4://' when 3 then 'socks5://' "
    "when 4 then 'socks://' else '' end) || (case when c_custkey % 13 = 0 then 'ab' else 'h' || "
    "(case when c_custkey % 10 = 0 then 10 else c_custkey end) || 'x' end) || ':' || ((c_custkey * 37) % 70000) || '/x'"
)
# over pages
RENDER_EXTRA = (
    "case page_id % 8 when 0 then '<script src=\"/js/React.min.js\"></script>' when 1 then '<div id=\"root\"></div>' "
    "when 2 then '<script>window.__NEXT_DATA__={}</script>' when 3 then '<p>Just a Moment</p>' "
    "when 4 then '<meta name=\"generator\" content=\"Nuxt 3\">' "
    "when 5 then '<script src=\"a.js\"></script><noscript>x</noscript><b onload = \"fetch (1)\">' else '' end"
)
# over part: a graph with cycles; n is the number of parts
EDGE_TARGET = "'/p/' || ((p_partkey * k + k) % n)"


# --- tables ---------------------------------------------------------------------


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "cast(ts as timestamp) AS ts",
        f"{HOST} AS host",
        f"{LOG_URL} AS url",
        f"{LOG_STATUS} AS status",
        f"{LOG_OK} AS ok",
        "value / 10 AS rt",
    )


def crawl_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the event schema plus event_id."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "cast(ts as timestamp) AS ts",
        f"{EVENT_NAME} AS event",
        f"{LOG_URL} AS url",
        f"{EVENT_STATUS} AS status",
        "cast(event_id % 3 as int) AS retries",
        "cast(event_id * 3 as bigint) AS bytes",
        "sha2(cast(event_id as string), 256) AS sha256",
    )


def part_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS page_id", f"{PART_URL} AS url")


def bounded_blocks(df: DataFrame, key: str, size: int) -> DataFrame:
    """Adds `page_id`: blocks of `size` neighbouring keys, so a rendered page stays small at any scale."""
    return df.withColumn("page_id", F.floor(F.col(key) / size))


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty product cards per page."""
    card = (
        "'<div class=\"product-wrapper\"><h4 class=\"price\">$' || cast(round(p_retailprice * 100) as bigint) || "
        "'</h4><a class=\"title\" href=\"/p/' || p_partkey || '\">' || p_name || '</a><p class=\"description\">' || "
        "p_type || ' ' || p_brand || ' part</p>' || "
        "(case when p_partkey % 2 = 0 then '<small>' || p_size || ' reviews</small>' else '' end) || "
        "'<img src=\"/i/' || p_partkey || '.png\"></div>'"
    )
    parts = bounded_blocks(table(spark, sf_dir, "part"), "p_partkey", 40)
    cards = parts.groupBy("page_id").agg(F.expr(f"listagg({card}, '') within group (order by p_partkey)").alias("cards"))
    return cards.selectExpr(
        "page_id",
        f"'{SITE}/list/' || page_id AS url",
        "'<html><head><title>List</title></head><body>' || cards || '</body></html>' AS html",
    )


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of up to twenty orders per page, below a header row."""
    row = (
        "'<tr><td>' || o_orderkey || '</td><td>' || o_orderstatus || '</td><td> ' || "
        "cast(round(o_totalprice * 100) as bigint) || '</td></tr>'"
    )
    orders = bounded_blocks(table(spark, sf_dir, "orders"), "o_orderkey", 20)
    rows = orders.groupBy("page_id").agg(F.expr(f"listagg({row}, '') within group (order by o_orderkey)").alias("rows"))
    return rows.selectExpr(
        "page_id",
        f"'{SITE}/orders/' || page_id AS url",
        "'<table><tr><th>key</th><th>status</th><th>cents</th></tr>' || rows || '</table>' AS html",
    )


def meta_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier pages with every kind of metadata; every second one has a product, every third a table."""
    nation = table(spark, sf_dir, "nation")
    joined = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.expr("s_nationkey = n_nationkey"))
    html = (
        "'<html><head><title>' || s_name || '</title><meta name=\"description\" content=\"About ' || s_name || '\">"
        "<meta property=\"og:title\" content=\"' || s_name || '\"><meta property=\"og:locality\" content=\"' || n_name || '\">"
        "<meta name=\"twitter:card\" content=\"' || n_name || '\"><meta name=\"rank\" content=\"0\">"
        "<meta name=\"rank\" content=\"' || s_suppkey || '\"><meta name=\"empty\" content=\"\">"
        "<script type=\"application/ld+json\">{\"@type\": \"Organization\", \"name\": \"' || s_name || '\", \"id\": ' || s_suppkey || '}</script>"
        "<script type=\"application/ld+json\">{broken</script></head><body>' || "
        "(case when s_suppkey % 2 = 0 then '<div class=\"item\"><h3>' || s_name || '</h3></div>' else '' end) || "
        "(case when s_suppkey % 3 = 0 then '<table><tr><td>' || s_suppkey || '</td></tr></table>' else '' end) || "
        "'</body></html>'"
    )
    return joined.selectExpr("s_suppkey AS page_id", f"'{SITE}/s/' || s_suppkey AS url", f"{html} AS html")


def escaped(text):
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as pages: a heading, then every line as a paragraph or list item, inside page chrome."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    blocks = F.transform(
        lines,
        lambda x, i: F.when(i % 3 == 2, F.concat(F.lit("<li>"), escaped(x), F.lit("</li>"))).otherwise(
            F.concat(F.lit("<p>"), escaped(x), F.lit("</p>"))
        ),
    )
    level = F.concat(F.lit("h"), (F.col("doc_id") % 6 + 1).cast("string"))
    heading = F.format_string("<%s> Doc %s </%s>", level, F.col("doc_id"), level)
    main = F.col("doc_id") % 2 == 1
    html = F.concat(
        F.format_string("<html><head><title>T%s</title><meta name='description' content='D%s'></head><body>", "doc_id", "doc_id"),
        F.lit("<nav><p>menu</p></nav>"),
        F.when(main, "<main>").otherwise(""),
        heading,
        F.array_join(blocks, ""),
        F.when(main, "</main>").otherwise(""),
        F.lit("<footer><p>foot</p></footer></body></html>"),
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"), F.expr(DOC_URL).alias("url"), html.alias("html")
    )


def link_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One element of every link kind per page, next to references that are no links."""
    kinds = {
        "anchor": '<a href="/x/anchor/{k}#top">a</a><a href="/x/anchor/{k}">again</a>',
        "onclick": "<b onclick=\"window.location = '/x/onclick/{k}'\">b</b>",
        "data_attr": '<i data-url=" /x/data_attr/{k} ">i</i>',
        "link_tag": '<link rel="canonical" href="/x/link_tag/{k}">',
        "iframe": '<iframe src="/x/iframe/{k}"></iframe>',
        "srcset": '<img srcset="/x/srcset/{k} 1x, , /x/srcset/{k} 2x">',
        "img": '<img src="/x/img/{k}">',
        "script": '<script src="/x/script/{m}"></script>',
        "media": '<video><source src="/x/media/{k}"></video>',
        "refresh": '<meta http-equiv="Refresh" content="5; URL=/x/refresh/{k}">',
        "base": '<base href="/x/base/{k}">',
        "inline_js": "<script>go('https://w.example.com/x/inline_js/{k}')</script>",
    }
    junk = '<a href="#a">x</a><a href="javascript:go()">x</a><a href="mailto:a@b.c">x</a><a href="tel:1">x</a><a href="data:x">x</a><a href="ftp://h/x">x</a><a href="">x</a>'
    html = "".join(kinds.values()) + junk
    text = F.replace(F.lit(html), F.lit("{k}"), F.col("p_partkey").cast("string"))
    text = F.replace(text, F.lit("{m}"), F.floor(F.col("p_partkey") / 4).cast("string"))
    return part_keys(spark, sf_dir).select(
        F.col("p_partkey").alias("page_id"),
        F.concat(F.lit(f"{SITE}/page/"), F.col("p_partkey").cast("string")).alias("url"),
        text.alias("html"),
    )


RELATIVE_FORMS = {
    # reference -> what it resolves to below https://w.example.com/a/b/c?z=1
    "'../x' || k": "'https://w.example.com/a/x' || k",
    "'./y' || k": "'https://w.example.com/a/b/y' || k",
    "'z' || k || '?q=1#f'": "'https://w.example.com/a/b/z' || k || '?q=1'",
    "'//other.example.com/p' || k": "'https://other.example.com/p' || k",
    "'?q=' || k": "'https://w.example.com/a/b/c?q=' || k",
    "'/r/../s/' || k": "'https://w.example.com/s/' || k",
    "'http://h.example.com/' || k || '#frag'": "'http://h.example.com/' || k",
    "'a b/' || k": "'https://w.example.com/a/b/a b/' || k",
}


def relative_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = " || ".join(f"'<a href=\"' || {form} || '\">t</a>'" for form in RELATIVE_FORMS)
    keyed = part_keys(spark, sf_dir).withColumn("k", F.col("p_partkey"))
    return keyed.selectExpr("p_partkey AS page_id", f"'{SITE}/a/b/c?z=1' AS url", f"{anchors} AS html")


def render_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages with one mark of client-side rendering each, by page_id % 8."""
    return table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"html || {RENDER_EXTRA} AS html")


def shell_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of little text; the number of scripts in their head is page_id % 7."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "url",
        "'<html><head>' || repeat('<script>x()</script>', cast(page_id % 7 as int)) || '</head><body>' || "
        "repeat('word ', cast(page_id % 80 as int)) || '<noscript>' || html || '</noscript></body></html>' AS html",
    )


def download_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One element per page that suggests a download in one way, by p_partkey % 7."""
    element = (
        "case p_partkey % 7 when 0 then '<a href=\"/f/' || p_partkey || '\">Download now</a>' "
        "when 1 then '<a download href=\"/f/' || p_partkey || '\">item</a>' "
        "when 2 then '<a onclick=\"download(1)\" href=\"/f/' || p_partkey || '\">item</a>' "
        "when 3 then '<a href=\"/f/' || p_partkey || '.pdf\">item</a>' "
        "when 4 then '<a href=\"/f/' || p_partkey || '.pdf?x=1\">item</a>' "
        "when 5 then '<a href=\"/DownLoad/' || p_partkey || '\">item</a>' "
        "else '<a href=\"/f/' || p_partkey || '\">item</a>' end"
    )
    return part_keys(spark, sf_dir).selectExpr(
        "p_partkey AS page_id", f"'{SITE}/d' AS url", f"'<p><a href=\"/home\">home</a></p>' || {element} AS html"
    )


def payload_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as code blocks beside a button that saves them."""
    html = F.concat(
        F.lit("<div><div><code>"),
        escaped(F.col("text")),
        F.lit("</code></div><button onclick=\"a.download='doc_"),
        F.col("doc_id").cast("string"),
        F.lit(".txt';saveBlob()\">get it</button></div>"),
    )
    docs = table(spark, sf_dir, "documents").filter(F.trim("text") != "")
    return docs.select(F.col("doc_id").alias("page_id"), F.expr(DOC_URL).alias("url"), html.alias("html"))


def next_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = (
        "case p_partkey % 6 when 0 then '<a rel=\"next\" href=\"/n/' || p_partkey || '\">more</a>' "
        "when 1 then '<a href=\"/o\">old</a><a class=\"next\" href=\"/n/' || p_partkey || '\">go</a>' "
        "when 2 then '<ul class=\"pagination\"><li><a href=\"/o\">1</a><a href=\"/n/' || p_partkey || '\">2</a></li></ul>' "
        "when 3 then '<a class=\"next\" href=\"/o\">x</a><a aria-label=\"Next\" href=\"/n/' || p_partkey || '\">y</a>' "
        "when 4 then '<a href=\"/n/' || p_partkey || '\">Next page</a>' else '<a href=\"/o\">old</a>' end"
    )
    return part_keys(spark, sf_dir).selectExpr("p_partkey AS page_id", f"'{SITE}/l' AS url", f"{html} AS html")


def api_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS page_id", f"{API_PAGE} AS url", f"{API_TEXT} AS html"
    )


def crawl_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey")
    keyed = part.select("p_partkey", F.lit(part.count()).alias("n"), F.explode(F.array(*map(F.lit, (3, 7, 11)))).alias("k"))
    return keyed.selectExpr("'/p/' || p_partkey AS src", f"{EDGE_TARGET} AS dst")


def endpoint_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(f"{ENDPOINT_LINE} AS line")


def stored_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes in the charset of their language, every second one without a declared type."""
    docs = table(spark, sf_dir, "documents")
    latin = F.col("text").rlike(r"^[\x00-\x7F\xA0-\xFF]*$")
    utf16 = F.col("lang") == "es"
    single_byte = F.col("lang").isin("fr", "de") & latin
    content = (
        F.when(utf16, F.encode("text", "UTF-16")).when(single_byte, F.encode("text", "ISO-8859-1"))
        .otherwise(F.encode("text", "UTF-8"))
    )
    charset = F.when(utf16, "utf-16").when(single_byte, "iso-8859-1").otherwise("utf-8")
    declared = F.when(utf16 | (F.col("doc_id") % 2 == 0), F.concat(F.lit("text/html; charset="), charset))
    return docs.select("doc_id", content.alias("content"), declared.alias("content_type"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as manifest rows."""
    return table(spark, sf_dir, "documents").selectExpr(
        f"{DOC_URL} AS url",
        "'files/' || doc_id || '.txt' AS path",
        "sha2(encode(text, 'UTF-8'), 256) AS sha256",
        "cast(octet_length(text) as bigint) AS bytes",
        "'text/plain' AS content_type",
    )
