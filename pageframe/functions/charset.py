"""Charset detection and decoding of stored page bytes."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pageframe.functions.constants import FALLBACK_ENCODINGS

META_WINDOW = 4096
_META_CHARSET = re.compile(rb"<meta[^>]+charset=[\"']?([^\"'>\s]+)", re.I)
_META_HTTP_EQUIV = re.compile(
    rb"<meta[^>]+http-equiv=[\"']?content-type[\"']?[^>]+content=[\"']?[^;\"']*charset=([^;\"'\s]+)", re.I
)


def _candidates(content: bytes, content_type: str):
    """Encodings to try, most trusted first."""
    declared = content_type.lower().partition("charset=")[2]
    if declared:
        yield declared.split(";")[0].strip().strip("\"'")
    if not content_type or "text/html" in content_type.lower():
        for pattern in (_META_CHARSET, _META_HTTP_EQUIV):
            found = pattern.search(content[:META_WINDOW])
            if found:
                yield found.group(1).decode("ascii", "ignore")
    yield from FALLBACK_ENCODINGS


def decode_bytes(content: bytes, content_type: str | None) -> tuple[str, str]:
    for name in _candidates(content, content_type or ""):
        try:
            text = content.decode(name)
            text.encode("utf-8")
        except (LookupError, UnicodeError, ValueError):
            continue
        return text.removeprefix("\ufeff"), name
    return content.decode("utf-8", "replace"), "utf-8"


def _decode_batch(content: pa.Array, content_type: pa.Array) -> pa.Array:
    texts, names = [], []
    for body, kind in zip(content.to_pylist(), content_type.to_pylist()):
        text, name = (None, None) if body is None else decode_bytes(body, kind)
        texts.append(text)
        names.append(name)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(names, pa.string())], ["text", "encoding"])


def decode(content: Column, content_type: Column) -> Column:
    """struct<text, encoding> of page bytes and their declared content type."""
    return F.arrow_udf(_decode_batch, "struct<text:string,encoding:string>")(content, content_type)
