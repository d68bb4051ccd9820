"""Signals mined from pages and text: API paths, secrets, rendering and challenge marks."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.functions.constants import (
    API_PATTERNS,
    APP_ROOT_IDS,
    BROWSER_CHECK_PHRASES,
    CHALLENGE_PHRASES,
    DYNAMIC_PATTERNS,
    DYNAMIC_URL_WORDS,
    FRAMEWORK_NAMES,
    GENERATOR_NAMES,
    HYDRATION_MARKS,
    SECRET_PATTERNS,
)
from pageframe.functions.html_tree import attr, explode_rows, find_all, find_first, has_attr, inside, is_tag, let, strip, subtree
from pageframe.functions.text import WORD
from pageframe.functions.urls import contains_any, resolve_one, url_struct
from pageframe.sources.readers import spread

MIN_SECRET = 20


# --- API paths ------------------------------------------------------------------

# Every API pattern matches inside a run of these characters.
_TOKEN_CHARS = f"{WORD}./:?-"


# A whole run holding a "/" or a data suffix. The look-behind starts a match only where a run
# starts, which keeps the scan linear on long runs.
_RUN = rf"(?<![{_TOKEN_CHARS}])(?=[{_TOKEN_CHARS}]*?(?:/|\.(?i:json|xml|csv)))[{_TOKEN_CHARS}]++"


def _java(pattern: str) -> str:
    return pattern.replace(r"\w", WORD).replace(r"\d", r"\p{Nd}")


def _runs(text: Column) -> Column:
    """Distinct runs of a text, each followed by a space unless it ends the whole text.

    "$" in a pattern means the end of the whole text, so it must not match at
    the end of any other run.
    """
    runs = F.transform(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)), lambda r: F.concat(r, F.lit(" ")))
    last = F.regexp_extract(text, rf"({_RUN})\n?\z", 1)
    return F.array_distinct(F.concat(runs, F.filter(F.array(last), lambda r: r != "")))


def api_matches_col(text: Column) -> Column:
    """Distinct API matches of a text.

    The text is first cut down to its distinct runs of URL characters, so the
    pattern list runs over a few short strings rather than the whole page.
    """

    def match(short):
        found = []
        for pattern in API_PATTERNS:
            if pattern.startswith(r"\."):
                # the whole URL up to the suffix
                whole = rf"(?iu)(?<![{_TOKEN_CHARS}])([{_TOKEN_CHARS}]*?{_java(pattern)})"
                found.append(F.regexp_extract_all(short, F.lit(whole), F.lit(1)))
            else:
                found.append(F.regexp_extract_all(short, F.lit(f"(?iu){_java(pattern)}"), F.lit(0)))
        return F.array_distinct(F.concat(*found))

    none = F.array().cast("array<string>")
    return let(F.array_join(_runs(text), ""), lambda short: F.when(short == "", none).otherwise(match(short)))


def api_urls_col(text: Column, base: Column) -> Column:
    """API matches as URLs: sockets stay absolute, everything else is resolved against the page."""

    def to_url(match):
        rooted = match.startswith("/") | match.startswith("http")
        path = F.when(rooted, match).otherwise(F.concat(F.lit("/"), match))
        return F.when(match.rlike("(?i)^wss?://"), match).otherwise(resolve_one(base, path))

    urls = F.transform(api_matches_col(text), to_url)
    return F.array_distinct(F.filter(urls, lambda u: u.isNotNull()))


def api_paths(pages: DataFrame, text_col: str = "html") -> DataFrame:
    """Distinct API URLs of a corpus with the first page that shows each."""
    based = spread(pages.select("page_id", text_col, url_struct(F.col("url")).alias("base")))
    found = explode_rows(based, ["page_id"], api_urls_col(F.col(text_col), F.col("base")), "api_url")
    return found.groupBy("api_url").agg(F.min("page_id").alias("first_page_id"), F.count("*").alias("n_pages"))


# --- secrets --------------------------------------------------------------------

# One cheap pass decides whether the pattern list has to run at all.
_SECRET_GATE = r"(?i)key|token|bearer|client[_-]?(?:id|secret)|authorization"


def secrets_col(text: Column) -> Column:
    """Array of (pattern_id, sha256, length, prefix) for every secret-like value; never the value."""

    def of_pattern(name, lead, value):
        found = F.regexp_extract_all(text, F.lit(f"(?i){_secret_java(lead)}({value})"), F.lit(1))
        long_enough = F.filter(F.array_distinct(found), lambda v: F.length(v) >= MIN_SECRET)
        return F.transform(
            long_enough,
            lambda v: F.struct(
                F.lit(name).alias("pattern_id"),
                F.sha2(v, 256).alias("sha256"),
                F.length(v).alias("length"),
                F.substring(v, 1, 4).alias("prefix"),
            ),
        )

    found = F.concat(*[of_pattern(*p) for p in SECRET_PATTERNS])
    return F.when(text.rlike(_SECRET_GATE), found)


def _secret_java(lead: str) -> str:
    return lead.replace(r"\s", r"[\s\p{Z}]")


def secret_findings(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Distinct secrets of a corpus: hash, length, masked prefix, and where they first occur."""
    found = explode_rows(spread(df.select(id_col, text_col)), [F.col(id_col).alias("id")], secrets_col(F.col(text_col)), "s")
    return (
        found.select("id", "s.*")
        .groupBy("sha256", "length", "prefix")
        .agg(F.min("pattern_id").alias("pattern_id"), F.min("id").alias("first_id"))
    )


def redact_secrets_col(text: Column, mark: str = "[REDACTED]") -> Column:
    redacted = text
    for _, lead, value in SECRET_PATTERNS:
        redacted = F.regexp_replace(redacted, f"(?i)({_secret_java(lead)}){value}", f"$1{mark}")
    return F.when(text.rlike(_SECRET_GATE), redacted).otherwise(text)


def redact_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    return spread(df).withColumn(text_col, redact_secrets_col(F.col(text_col)))


# --- rendering ------------------------------------------------------------------


def is_challenge(html: Column, browser_check: bool = False) -> Column:
    phrases = CHALLENGE_PHRASES + (BROWSER_CHECK_PHRASES if browser_check else [])
    return contains_any(F.lower(html), phrases)


def challenge_pages(pages: DataFrame, browser_check: bool = False) -> DataFrame:
    return pages.withColumn("is_challenge", is_challenge(F.col("html"), browser_check))


def drop_challenge_pages(pages: DataFrame, browser_check: bool = False) -> DataFrame:
    return pages.filter(~is_challenge(F.col("html"), browser_check))


def _little_text(tree: Column) -> Column:
    """Under 200 characters of body text beside more than three scripts left outside the body."""
    nodes = tree["nodes"]

    def judge(body):
        cut = find_all(subtree(tree, body), lambda n: is_tag(n, "noscript"))
        strings = F.transform(
            F.sequence(body["s0"], body["s1"] - 1),
            lambda i: F.when(
                ~F.exists(cut, lambda c: (i >= c["s0"]) & (i < c["s1"])), strip(F.get(tree["strings"], i))
            ).otherwise(""),
        )
        size = F.when(body["s1"] > body["s0"], F.length(F.array_join(strings, ""))).otherwise(0)
        scripts = F.filter(nodes, lambda n: is_tag(n, "script") & ~inside(n, body))
        return (size < 200) & (F.size(scripts) > 3)

    return let(find_first(nodes, lambda n: is_tag(n, "body")), judge)


def render_class(parsed: DataFrame) -> DataFrame:
    """The six marks of a page that needs rendering, and whether any is set.

    `parsed` must keep `html`: two marks are plain searches in the markup.
    """
    tree, html = F.col("tree"), F.col("html")
    nodes = tree["nodes"]
    generator = find_first(nodes, lambda n: is_tag(n, "meta") & (attr(n, "name") == "generator"))
    marks = {
        "framework_script": F.exists(
            nodes, lambda n: is_tag(n, "script") & contains_any(F.lower(attr(n, "src")), FRAMEWORK_NAMES)
        ),
        "app_root": F.exists(nodes, lambda n: attr(n, "id").isin(APP_ROOT_IDS) | has_attr(n, "data-reactroot")),
        "little_text": _little_text(tree),
        "hydration": contains_any(html, HYDRATION_MARKS),
        "challenge": is_challenge(html),
        "generator": contains_any(F.lower(attr(generator, "content")), GENERATOR_NAMES),
    }
    flags = {name: F.coalesce(mark, F.lit(False)) for name, mark in marks.items()}
    return parsed.select("page_id", *[flag.alias(name) for name, flag in flags.items()]).withColumn(
        "needs_render", reduce(or_, [F.col(name) for name in flags])
    )


def dynamic_score_col(html: Column) -> Column:
    lowered = F.lower(html)
    return reduce(add, [lowered.rlike(f"(?is){p}").cast("int") for p in DYNAMIC_PATTERNS])


def dynamic_score(pages: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Score of script-built pages and the verdict; `targets` names pages whose static links suffice."""
    html = F.col("html")
    scored = spread(pages.select("page_id", "url", "html")).select(
        "page_id",
        contains_any(F.lower(F.col("url")), DYNAMIC_URL_WORDS).alias("url_says"),
        (F.length(strip(html)) < 500).alias("is_short"),
        dynamic_score_col(html).alias("score"),
    )
    score = F.col("score")
    needed = F.col("url_says") | (score >= 3) | (F.col("is_short") & (score > 0))
    scored = scored.select("page_id", "score", needed.alias("needs_dynamic"))
    if targets is None:
        return scored
    with_targets = targets.filter("has_targets").select("page_id", F.lit(True).alias("settled"))
    return scored.join(with_targets, "page_id", "left").select(
        "page_id", "score", (F.col("needs_dynamic") & F.col("settled").isNull()).alias("needs_dynamic")
    )
