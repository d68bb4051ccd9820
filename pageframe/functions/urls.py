"""URL columns: parts, resolution, extensions, names. All native expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageframe.functions.html_tree import let, strip

SKIPPED_PREFIXES = ("#", "javascript:", "mailto:", "tel:", "data:")


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def scheme(url: Column) -> Column:
    return F.lower(_group(url, r"^([A-Za-z][A-Za-z0-9+.-]*):"))


def authority(url: Column) -> Column:
    return _group(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)")


def path(url: Column) -> Column:
    return _group(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)")


def query(url: Column) -> Column:
    return _group(url, r"^[^?#]*\?([^#]*)")


def fragment(url: Column) -> Column:
    return _group(url, r"(?s)^[^#]*#(.*)")


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def basename(path_col: Column) -> Column:
    return F.substring_index(path_col, "/", -1)


def extension(name: Column) -> Column:
    """Lower-cased extension of the last path segment; a name of dots only before it has none."""
    ext = F.lower(_group(name, r"[^/.][^/]*\.([^/.]*)$"))
    return F.when(ext == "mdc", "md").otherwise(ext)


def url_extension(url: Column) -> Column:
    return extension(path(url))


def url_key(url: Column) -> Column:
    return F.md5(url)


def url_struct(url: Column) -> Column:
    return F.struct(
        scheme(url).alias("scheme"),
        authority(url).alias("authority"),
        path(url).alias("path"),
        query(url).alias("query"),
    )


def _fold_dots(segments: Column) -> Column:
    """Resolve "." and ".." over an array of path segments."""
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        segments,
        empty,
        lambda kept, seg: F.when(seg == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        .when(seg == ".", kept)
        .otherwise(F.concat(kept, F.array(seg))),
    )
    ends_in_dots = F.element_at(segments, -1).isin(".", "..")
    return F.array_join(F.when(ends_in_dots, F.concat(folded, F.array(F.lit("")))).otherwise(folded), "/")


def _with_query(prefix: Column, query_col: Column) -> Column:
    return F.when(query_col == "", prefix).otherwise(F.concat(prefix, F.lit("?"), query_col))


def _join_relative(base: Column, ref: Column) -> Column:
    """`ref` is a struct of path and query with neither scheme nor authority."""
    origin = F.concat(base["scheme"], F.lit("://"), base["authority"])
    rooted = ref["path"].startswith("/")
    base_dir = _group(base["path"], r"(?s)^(.*/)")

    def merge(parts):
        last = F.size(parts) - 1
        return F.when(rooted, parts).otherwise(F.filter(parts, lambda s, i: (s != "") | (i == 0) | (i == last)))

    joined = F.split(F.when(rooted, ref["path"]).otherwise(F.concat(base_dir, ref["path"])), "/")
    merged = let(merge(joined), _fold_dots)
    merged = F.concat(F.lit("/"), F.regexp_replace(merged, "^/", ""))
    same_page = _with_query(
        F.concat(origin, base["path"]), F.when(ref["query"] == "", base["query"]).otherwise(ref["query"])
    )
    return F.when(ref["path"] == "", same_page).otherwise(_with_query(F.concat(origin, merged), ref["query"]))


def _resolve_general(base: Column, raw: Column) -> Column:
    """Any reference that the quick forms of `resolve_one` do not cover."""
    own = scheme(raw)
    rest = F.when(own == "", raw).otherwise(_group(raw, r"(?s)^[^:]*:(.*)"))
    ref = F.struct(
        own.alias("scheme"),
        _group(rest, "^//([^/?#]*)").alias("authority"),
        _group(rest, r"^(?://[^/?#]*)?([^?#]*)").alias("path"),
        _group(rest, r"^[^?#]*\?([^#]*)").alias("query"),
    )

    def join(r):
        absolute = _with_query(F.concat(base["scheme"], F.lit("://"), r["authority"], r["path"]), r["query"])
        foreign = (r["scheme"] != "") & (r["scheme"] != base["scheme"])
        return F.when(~foreign, F.when(r["authority"] != "", absolute).otherwise(_join_relative(base, r)))

    return let(ref, join)


def resolve_one(base: Column, raw: Column) -> Column:
    """Absolute http(s) URL, without fragment, of one raw reference; NULL when it is no web link.

    `base` is a `url_struct`. Plain absolute and root-relative references, nearly
    all there are, take the first branches.
    """
    origin = F.concat(base["scheme"], F.lit("://"), base["authority"])

    def join(r):
        plain = ~r.contains("#") & ~r.endswith("?")
        rooted = r.startswith("/") & ~r.startswith("//") & ~r.contains("/.")
        absolute = r.rlike(r"^https?://[^/?#]")
        foreign = ~r.startswith(F.concat(base["scheme"], F.lit(":")))
        return (
            F.when((r == "") | starts_with_any(r, SKIPPED_PREFIXES), F.lit(None).cast("string"))
            .when(plain & rooted, F.concat(origin, r))
            .when(plain & absolute, r)
            .when(absolute & foreign & ~r.contains("#"), r)
            .when(absolute & foreign, F.regexp_replace(without_fragment(r), r"\?$", ""))
            .otherwise(_resolve_general(base, r))
        )

    joined = let(F.regexp_replace(strip(raw), r"[\t\r\n]", ""), join)
    return let(joined, lambda url: F.when(url.rlike("^https?://"), url))


def resolve_all(base: Column, raws: Column) -> Column:
    """Distinct resolved URLs of an array of raw references, in order of appearance."""
    urls = F.transform(F.array_distinct(raws), lambda r: resolve_one(base, r))
    return F.array_distinct(F.filter(urls, lambda u: u.isNotNull()))


def starts_with_any(text: Column, prefixes) -> Column:
    return reduce(or_, [text.startswith(p) for p in prefixes])


def contains_any(text: Column, parts) -> Column:
    return reduce(or_, [text.contains(p) for p in parts], F.lit(False))


# --- names ----------------------------------------------------------------------


def display_url(url: Column, start_url: str) -> Column:
    """The URL relative to the crawl root; "/" for the root itself."""
    start = F.lit(start_url)
    origin = F.concat(F.regexp_extract(start, r"^([^/]*//[^/?#]*)", 1))
    root = F.concat(origin, F.regexp_replace(path(start), "/+$", ""))
    short = F.when(url.startswith(root), F.substr(url, F.length(root) + 1)).otherwise(F.replace(url, origin, F.lit("")))
    return F.when(short == "", "/").otherwise(short)


def site_folder(url: Column, fallback: str = "site_download") -> Column:
    """A folder name for a site: authority and path with unsafe characters as "_"."""
    trail = F.regexp_replace(path(url), "^/+|/+$", "")
    name = F.when(trail == "", authority(url)).otherwise(F.concat(authority(url), F.lit("_"), trail))
    safe = F.btrim(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"), F.lit("_"))
    return F.when(safe == "", F.lit(fallback)).otherwise(safe)


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "")


def mdc_to_md(name: Column) -> Column:
    return F.regexp_replace(name, r"\.mdc$", ".md")


def shortened(name: Column, url: Column, max_chars: int) -> Column:
    """A name of at most `max_chars` characters; a longer one keeps its extension and gets digits of the URL's key."""
    ext = F.regexp_extract(name, r"[^.](\.[^.]{1,20})$", 1)
    tail = F.concat(F.lit("_"), F.substring(url_key(url), 1, 16), ext)
    return F.when(F.length(name) <= max_chars, name).otherwise(
        F.concat(F.substr(name, F.lit(1), F.lit(max_chars) - F.length(tail)), tail)
    )


def artifact_name(
    url: Column, content_type: Column, disposition: Column, fallback: str = "download", max_chars: int = 200
) -> Column:
    """File name of an artifact: its declared name, else the URL's, with an extension by type."""
    declared = F.btrim(_group(disposition, r"(?s)filename=(.*?)(?:filename=|$)"), F.lit("\"'"))
    base = basename(path(url))
    base = F.when(base == "", "downloaded_file").otherwise(base)
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    suffix = F.when(kind.contains("markdown") | kind.contains("text/plain"), ".md").otherwise(".bin")
    named = F.when(base.rlike(r"[^.].*\.[^.]*$"), base).otherwise(F.concat(base, suffix))
    name = mdc_to_md(F.when(F.coalesce(declared, F.lit("")) != "", declared).otherwise(named))
    safe = shortened(safe_file_name(name), url, max_chars)
    return F.when(safe == "", F.concat(F.lit(f"{fallback}_"), F.substring(url_key(url), 1, 8), F.lit(".md"))).otherwise(safe)


def layout_path(url: Column) -> Column:
    """Folder path and file name a URL is stored under, before repeats are numbered."""
    trail = F.regexp_replace(path(url), "^/+|/+$", "")
    name = basename(trail)
    name = F.when(name == "", "index.html").when(name.contains("."), name).otherwise(F.concat(name, F.lit(".html")))
    folder = F.regexp_replace(trail, r"[^/]*$", "")
    return F.concat(folder, name)
