"""Text columns: cleaning, keywords, entities."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pageframe.functions.html_tree import strip

# Java's \w and \s know ASCII only; these are the Unicode classes meant.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\p{Z}\x0b\x1c-\x1f\x85"


def _unescape(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in text.to_pylist()], pa.string())


def unescape(text: Column) -> Column:
    """Replace character references. Rows without an ampersand skip the UDF's work."""
    return F.coalesce(F.arrow_udf(_unescape, "string")(F.when(text.contains("&"), text)), text)


def strip_markup(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?s)<script.*?</script>", "")
    text = F.regexp_replace(text, r"(?s)<style.*?</style>", "")
    return F.regexp_replace(text, r"<[^>]+>", " ")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


def clean_text(text: Column, enabled: bool = True) -> Column:
    """Markup removed, entities resolved, white space collapsed, odd characters dropped."""
    if not enabled:
        return text
    plain = collapse_spaces(unescape(strip_markup(text)))
    return strip(F.regexp_replace(plain, f"[^{WORD}{SPACE}.,!?;:'\"()-]", ""))


NAMED_GROUP, NAMED_BACKREFERENCE = re.compile(r"\(\?P<(\w+)>"), re.compile(r"\(\?P=(\w+)\)")


def engine_pattern(keyword: str) -> str:
    """A keyword as the engine runs it: case-blind, Unicode classes, named groups in its own spelling."""

    def name(match: re.Match) -> str:
        return match.group(1).replace("_", "")

    pattern = NAMED_GROUP.sub(lambda m: f"(?<{name(m)}>", keyword)
    return "(?iU)" + NAMED_BACKREFERENCE.sub(lambda m: rf"\k<{name(m)}>", pattern)


def check_pattern(pattern: str) -> None:
    """Raises ValueError for a pattern that the engine's regular expressions (java.util.regex) do not know.

    The engine itself tries it on a literal, which is folded while the plan is made and starts no job.
    """
    spark = SparkSession.active()
    try:
        spark.sql("SELECT regexp_extract_all('', :pattern, 0) AS found", {"pattern": pattern}).collect()
    except Exception as error:
        raise ValueError(f"not a pattern: {pattern}") from error


def keyword_matches(text: Column, keywords: list[str | int | float]) -> Column:
    """Sorted distinct matches of case-insensitive patterns.

    Patterns are java.util.regex ones; Python's named groups and references to them are translated. A keyword that is
    not a string is looked up as plain text. Patterns are checked here, by the engine that will run them, so a bad
    one fails before any job on data starts.
    """
    found = []
    for keyword in keywords:
        if isinstance(keyword, str):
            pattern = engine_pattern(keyword)
            check_pattern(pattern)
            found.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        else:
            plain = str(keyword)
            found.append(F.when(F.lower(text).contains(plain.lower()), F.array(F.lit(plain))).otherwise(F.array()))
    if not found:
        return F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(*found)))
