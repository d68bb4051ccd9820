"""Links of a page, by kind, resolved and distinct, without leaving the page's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.functions.html_tree import attr, explode_rows, find_all, find_first, has_attr, is_tag, strip, subtree
from pageframe.functions.urls import resolve_all, resolve_one, url_struct

DATA_ATTRIBUTES = ["data-href", "data-url", "data-link", "data-target", "data-src"]
# Patterns that find URLs in script code and meta refreshes.
ONCLICK_URL = r"(?:location\.href|window\.location|document\.location)\s*=\s*['\"]([^'\"]+)['\"]"
REFRESH_URL = r"(?i)url\s*=\s*['\"]?([^'\" >]+)"
QUOTED_URL = r"[\"'](https?://[^\"']+)[\"']"


def _attribute_of(tag: str, name: str):
    def raws(tree):
        return F.transform(find_all(tree["nodes"], lambda n: is_tag(n, tag) & has_attr(n, name)), lambda n: attr(n, name))

    return raws


def _onclick(tree):
    found = find_all(tree["nodes"], lambda n: has_attr(n, "onclick"))
    return F.flatten(F.transform(found, lambda n: F.regexp_extract_all(attr(n, "onclick"), F.lit(ONCLICK_URL), F.lit(1))))


def _data_attributes(tree):
    per_node = F.transform(tree["nodes"], lambda n: F.array(*[attr(n, name) for name in DATA_ATTRIBUTES]))
    return F.filter(F.flatten(per_node), lambda raw: raw.isNotNull())


def _srcset(tree):
    sets = F.transform(find_all(tree["nodes"], lambda n: is_tag(n, "img") & has_attr(n, "srcset")), lambda n: attr(n, "srcset"))
    items = F.flatten(F.transform(sets, lambda s: F.split(s, ",")))
    return F.transform(items, lambda item: F.get(F.split(strip(item), r"[\s\p{Z}]+"), F.lit(0)))


def _media(tree):
    def of_one(media):
        own = F.filter(F.array(attr(media, "src")), lambda raw: raw.isNotNull())
        sources = find_all(subtree(tree, media), lambda n: is_tag(n, "source") & has_attr(n, "src"))
        return F.concat(own, F.transform(sources, lambda n: attr(n, "src")))

    return F.flatten(F.transform(find_all(tree["nodes"], lambda n: is_tag(n, "video", "audio")), of_one))


def _refresh(tree):
    metas = find_all(tree["nodes"], lambda n: is_tag(n, "meta") & F.lower(attr(n, "http-equiv")).contains("refresh"))
    return F.transform(metas, lambda n: F.regexp_extract(F.coalesce(attr(n, "content"), F.lit("")), REFRESH_URL, 1))


def _base(tree):
    base = find_first(tree["nodes"], lambda n: is_tag(n, "base") & has_attr(n, "href"))
    return F.filter(F.array(attr(base, "href")), lambda raw: raw.isNotNull())


def _inline_scripts(tree):
    scripts = find_all(tree["nodes"], lambda n: is_tag(n, "script") & n["raw"].isNotNull())
    return F.flatten(F.transform(scripts, lambda n: F.regexp_extract_all(n["raw"], F.lit(QUOTED_URL), F.lit(1))))


# kind -> raw references of that kind in a tree
LINK_KINDS = {
    "anchor": _attribute_of("a", "href"),
    "onclick": _onclick,
    "data_attr": _data_attributes,
    "link_tag": _attribute_of("link", "href"),
    "iframe": _attribute_of("iframe", "src"),
    "srcset": _srcset,
    "img": _attribute_of("img", "src"),
    "script": _attribute_of("script", "src"),
    "media": _media,
    "refresh": _refresh,
    "base": _base,
    "inline_js": _inline_scripts,
}


def _base_struct(honor_base: bool) -> Column:
    page = url_struct(F.col("url"))
    if not honor_base:
        return page
    declared = resolve_all(page, _base(F.col("tree")))
    return url_struct(F.coalesce(F.get(declared, F.lit(0)), F.col("url")))


def _with_base(parsed: DataFrame, honor_base: bool) -> DataFrame:
    """Adds `base`. A <base> element is a link but resolves nothing unless `honor_base`."""
    return parsed.withColumn("base", _base_struct(honor_base))


def links(parsed: DataFrame, kinds: list[str] | None = None, honor_base: bool = False) -> DataFrame:
    """One row per page, link kind and URL."""
    tree, base = F.col("tree"), F.col("base")
    # A reference travels as one string behind its kind, as strings are told apart by hash and structs in pairs.
    raws = F.concat(*[F.transform(LINK_KINDS[kind](tree), _tagged(kind)) for kind in kinds or LINK_KINDS])
    resolved = F.transform(F.array_distinct(raws), lambda r: F.concat(_kind(r), F.lit(" "), resolve_one(base, _rest(r))))
    found = F.transform(
        F.array_distinct(F.filter(resolved, lambda r: r.isNotNull())),
        lambda r: F.struct(_kind(r).alias("link_kind"), _rest(r).alias("url")),
    )
    rows = explode_rows(_with_base(parsed, honor_base), ["page_id", F.col("url").alias("src_url")], found, "link")
    return rows.select("page_id", "src_url", "link.link_kind", "link.url")


def _tagged(kind: str):
    return lambda raw: F.concat(F.lit(f"{kind} "), raw)


def _kind(tagged: Column) -> Column:
    return F.substring_index(tagged, " ", 1)


def _rest(tagged: Column) -> Column:
    return F.substr(tagged, F.locate(" ", tagged) + 1)


def links_col(tree: Column, base: Column, kinds: list[str] | None = None) -> Column:
    """Sorted distinct URLs of a page over all kinds."""
    raws = F.concat(*[LINK_KINDS[kind](tree) for kind in kinds or LINK_KINDS])
    return F.array_sort(resolve_all(base, raws))


def page_links(parsed: DataFrame, kinds: list[str] | None = None, honor_base: bool = False) -> DataFrame:
    """One row per page and URL, distinct over the kinds."""
    based = _with_base(parsed, honor_base)
    urls = links_col(F.col("tree"), F.col("base"), kinds)
    return explode_rows(based, ["page_id", F.col("url").alias("src_url")], urls, "link").withColumnRenamed("link", "url")
