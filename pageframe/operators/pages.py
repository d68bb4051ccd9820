"""Page extractors.

`parse_pages` gives one row per page with its element tree; every extractor
below is a narrow projection of that, so a job parses each page once and
shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.functions.constants import BINARY_TYPES
from pageframe.functions.html_tree import (
    SPACE_CHARS,
    attr,
    attr_contains,
    explode_rows,
    find_all,
    find_first,
    first,
    has_class,
    is_tag,
    let,
    parse_tree,
    strip,
    subtree,
    text_of,
)
from pageframe.functions.urls import contains_any
from pageframe.sources.readers import bounded_batches, spread

HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
PRODUCT_FIELDS = ["title", "price", "description", "reviews", "image", "url"]


def parse_pages(pages: DataFrame, *keep: str) -> DataFrame:
    """page_id, url, tree and the columns named in `keep`; the html itself goes no further."""
    return bounded_batches(spread(pages)).select("page_id", "url", *keep, parse_tree("html").alias("tree"))


def to_nodes(parsed: DataFrame) -> DataFrame:
    """One row per element."""
    text = text_of(F.col("tree"), F.col("node"))
    return explode_rows(parsed, ["page_id", "tree"], F.col("tree.nodes"), "node").select(
        "page_id",
        "node.node_id",
        "node.end_id",
        "node.parent_id",
        "node.depth",
        "node.tag",
        "node.attrs",
        F.filter(F.split(F.coalesce("node.attrs.class", F.lit("")), r"\s+"), lambda c: c != "").alias("classes"),
        "node.raw",
        text.alias("text"),
    )


# --- column forms ---------------------------------------------------------------


def title_col(tree: Column) -> Column:
    """The only string of the first title; NULL when it holds more or nothing, '' without a title."""

    def only_string(node):
        chain = F.concat(F.array(node), subtree(tree, node))
        single = F.forall(chain, lambda n: n["n_children"] == 1) & (node["s1"] - node["s0"] == 1)
        return F.when(node.isNull(), F.lit("")).when(single, text_of(tree, node))

    return let(find_first(tree["nodes"], lambda n: is_tag(n, "title")), only_string)


def page_text_col(tree: Column) -> Column:
    return F.array_join(tree["strings"], "")


def headings_col(tree: Column) -> Column:
    """Map from h1..h6 to stripped texts in document order; levels not used are absent."""
    found = F.transform(
        find_all(tree["nodes"], lambda n: is_tag(n, *HEADING_TAGS)),
        lambda n: F.struct(n["tag"].alias("tag"), strip(text_of(tree, n)).alias("text")),
    )

    def by_level(heads):
        levels = F.array_sort(F.array_distinct(F.transform(heads, lambda h: h["tag"])))
        entries = F.transform(
            levels,
            lambda level: F.struct(
                level, F.transform(F.filter(heads, lambda h: h["tag"] == level), lambda h: h["text"])
            ),
        )
        return F.map_from_entries(entries)

    return let(found, by_level)


def _last_wins(pairs: Column) -> Column:
    """A map of (key, value) structs where a later pair replaces an earlier one."""

    def to_map(found):
        keys = F.array_distinct(F.transform(found, lambda p: p["key"]))
        entries = F.transform(
            keys, lambda k: F.struct(k, F.element_at(F.filter(found, lambda p: p["key"] == k), -1)["value"])
        )
        return F.map_from_entries(entries)

    return let(pairs, to_map)


def _meta_pairs(tree: Column, key) -> Column:
    metas = find_all(tree["nodes"], lambda n: is_tag(n, "meta"))
    return F.transform(metas, lambda n: F.struct(key(n).alias("key"), attr(n, "content").alias("value")))


def _or_else(a: Column, b: Column) -> Column:
    return F.coalesce(F.nullif(a, F.lit("")), b)


def meta_map_col(tree: Column) -> Column:
    pairs = _meta_pairs(tree, lambda n: _or_else(attr(n, "name"), attr(n, "property")))
    return _last_wins(F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != "")))


def _prefixed_meta(tree: Column, name: str, prefix: str) -> Column:
    return _last_wins(F.filter(_meta_pairs(tree, lambda n: attr(n, name)), lambda p: p["key"].startswith(prefix)))


def open_graph_col(tree: Column) -> Column:
    return _prefixed_meta(tree, "property", "og:")


def twitter_card_col(tree: Column) -> Column:
    return _prefixed_meta(tree, "name", "twitter:")


def json_ld_col(tree: Column) -> Column:
    """The JSON-LD scripts that parse, as compact JSON text."""
    scripts = find_all(tree["nodes"], lambda n: is_tag(n, "script") & (attr(n, "type") == "application/ld+json"))
    parsed = F.transform(scripts, lambda n: F.to_json(F.try_parse_json(n["raw"])))
    return F.filter(parsed, lambda j: j.isNotNull())


# --- products -------------------------------------------------------------------
#
# Thirty rules make a large expression; as SQL text it is built in one step.


def _tag(name: str) -> str:
    return f"n.tag = '{name}'"


def _class(name: str, node: str = "n") -> str:
    return rf"array_contains(split({node}.attrs['class'], '\\s+'), '{name}')"


def _class_part(part: str) -> str:
    return f"contains(n.attrs['class'], '{part}')"


def _has(name: str) -> str:
    return f"n.attrs['{name}'] IS NOT NULL"


def _in_caption(tag: str) -> str:
    return f"{_tag(tag)} AND n.in_caption"


# What makes a product card, best first. Only the first rule with a match is used.
CARD_RULES = [
    _class("product-wrapper"),
    _class("thumbnail"),
    _class("product"),
    _class_part("product"),
    _class("item"),
    _has("data-product"),
]
# Where the fields of a card are looked up, best first.
TITLE_RULES = [
    _class("title"),
    _tag("h1"),
    _tag("h2"),
    _tag("h3"),
    _tag("h4"),
    _class("product-title"),
    _class("name"),
    _class_part("title"),
    _class_part("name"),
    f"{_tag('a')} AND {_has('title')}",
]
PRICE_RULES = [
    _class("price"),
    _class("cost"),
    _class_part("price"),
    _has("data-price"),
    _in_caption("h4"),
    _tag("h4"),
]
DESCRIPTION_RULES = [
    _class("description"),
    _class("specs"),
    _in_caption("p"),
    _tag("p"),
    _class_part("desc"),
    _class_part("spec"),
]
REVIEW_RULES = [
    _class_part("review"),
    _class_part("rating"),
    _class("stars"),
    _tag("small"),
    _class_part("star"),
]
# What makes a field's text `t` good enough to stop at.
IS_PRICE = r"contains(t, '$') OR regexp_replace(t, '[.,]', '') RLIKE '^\\p{Nd}+$'"
IS_DESCRIPTION = "length(t) > 10"
IS_REVIEW = "contains(lower(t), 'review')"


def _let_sql(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _strip_sql(text: str) -> str:
    return f"btrim({text}, '{SPACE_CHARS}')"


def _first_sql(nodes: str, rule: str) -> str:
    return f"get(filter({nodes}, n -> {rule}), 0)"


def _text_sql(node: str) -> str:
    return _let_sql("e", node, _strip_sql("array_join(slice(tree.strings, e.s0 + 1, e.s1 - e.s0), '')"))


def _field_sql(rules: list[str], accept: str) -> str:
    """Text of each rule's first node, in rule order, until one is accepted."""
    texts = [
        f"get(filter(array({_text_sql(_first_sql('below', rule))}), t -> t IS NOT NULL AND ({accept})), 0)"
        for rule in rules
    ]
    return f"coalesce({', '.join(texts)})"


def _attribute_sql(tag: str, name: str) -> str:
    """Attribute of the first element of a kind: '' when it lacks it, NULL without such an element."""
    return _let_sql("e", _first_sql("below", _tag(tag)), f"if(e IS NULL, NULL, coalesce(e.attrs['{name}'], ''))")


def products_col() -> Column:
    """Product cards of the `tree` column that have a title or a price."""
    title = _let_sql(
        "h",
        f"coalesce({', '.join(_first_sql('below', rule) for rule in TITLE_RULES)})",
        f"if(h IS NULL, NULL, coalesce(nullif({_text_sql('h')}, ''), {_strip_sql("coalesce(h.attrs['title'], '')")}))",
    )
    fields = {
        "title": title,
        "price": _field_sql(PRICE_RULES, IS_PRICE),
        "description": _field_sql(DESCRIPTION_RULES, IS_DESCRIPTION),
        "reviews": _field_sql(REVIEW_RULES, IS_REVIEW),
        "image": _attribute_sql("img", "src"),
        "url": _attribute_sql("a", "href"),
    }
    product = f"named_struct({', '.join(f"'{name}', {value}" for name, value in fields.items())})"
    below = "slice(tree.nodes, card.node_id + 2, card.end_id - card.node_id)"
    hits = [_let_sql("c", f"filter(tree.nodes, n -> {rule})", "if(size(c) > 0, c, NULL)") for rule in CARD_RULES]
    cards = f"coalesce({', '.join(hits)}, slice(tree.nodes, 1, 0))"
    found = f"transform({cards}, card -> {_let_sql('below', below, product)})"
    return F.expr(f"filter({found}, p -> coalesce(p.title, '') != '' OR p.price IS NOT NULL)")


# --- tables, markdown -----------------------------------------------------------


def _cells(tree: Column, node: Column) -> Column:
    cells = find_all(subtree(tree, node), lambda n: is_tag(n, "th", "td"))
    return F.transform(cells, lambda n: strip(text_of(tree, n)))


def _table(tree: Column, table: Column, max_cells: int | None, max_rows: int | None) -> Column:
    rows = find_all(subtree(tree, table), lambda n: is_tag(n, "tr"))
    heads = find_all(subtree(tree, table), lambda n: is_tag(n, "th", "td"))
    heads = heads if max_cells is None else F.slice(heads, 1, max_cells)
    data = F.slice(rows, 2, F.size(rows) if max_rows is None else F.lit(max_rows))
    return F.struct(
        F.transform(heads, lambda n: strip(text_of(tree, n))).alias("headers"),
        F.coalesce(_cells(tree, first(rows)), F.array().cast("array<string>")).alias("header_row"),
        F.filter(F.transform(data, lambda r: _cells(tree, r)), lambda r: F.size(r) > 0).alias("rows"),
    )


def html_tables_col(tree: Column, max_cells: int | None = None, max_rows: int | None = None) -> Column:
    """headers: the cells of the table, rows: its rows below the first; whole unless the caller sets a bound."""
    tables = F.transform(
        find_all(tree["nodes"], lambda n: is_tag(n, "table")), lambda t: _table(tree, t, max_cells, max_rows)
    )
    return F.filter(tables, lambda t: (F.size(t["headers"]) > 0) | (F.size(t["rows"]) > 0))


# Containers of the main content, best first.
MAIN_RULES = [
    lambda n: is_tag(n, "main"),
    lambda n: attr(n, "role") == "main",
    lambda n: has_class(n, "main-content"),
    lambda n: has_class(n, "content"),
    lambda n: is_tag(n, "article"),
    lambda n: has_class(n, "rule-content"),
    lambda n: has_class(n, "markdown-body"),
]
BLOCK_TAGS = (*HEADING_TAGS, "p", "pre", "code", "li")


def _blocks(tree: Column, nodes: Column, strings: Column) -> Column:
    blocks = F.transform(
        find_all(nodes, lambda n: is_tag(n, *BLOCK_TAGS)),
        lambda n: F.struct(n["tag"].alias("tag"), strip(text_of(tree, n, strings)).alias("text")),
    )
    return F.transform(
        F.filter(blocks, lambda b: b["text"] != ""),
        lambda b: F.when(b["tag"] == "p", F.concat(b["text"], F.lit("\n\n")))
        .when(b["tag"] == "li", F.concat(F.lit("- "), b["text"], F.lit("\n")))
        .when(b["tag"].isin("pre", "code"), F.concat(F.lit("```\n"), b["text"], F.lit("\n```\n\n")))
        .otherwise(
            F.concat(
                F.repeat(F.lit("#"), F.substring(b["tag"], 2, 1).cast("int")), F.lit(" "), b["text"], F.lit("\n\n")
            )
        ),
    )


def main_markdown_col(tree: Column) -> Column:
    """Main content as Markdown: title, description, then headings, paragraphs, code and list items.

    Without a main container the body is used, less navigation, header and footer.
    """
    nodes = tree["nodes"]
    box = F.coalesce(*[find_first(nodes, rule) for rule in MAIN_RULES])
    body = find_first(nodes, lambda n: is_tag(n, "body"))

    def whole_body(node):
        # chrome around the body is not cut; chrome inside it comes after it in document order
        kept = F.filter(subtree(tree, node), lambda n: n["chrome_id"] <= node["node_id"])
        strings = F.zip_with(
            tree["strings"], tree["string_chrome"], lambda s, c: F.when(c > node["node_id"], F.lit("")).otherwise(s)
        )
        return let(strings, lambda visible: _blocks(tree, kept, visible))

    blocks = F.coalesce(
        let(box, lambda node: _blocks(tree, subtree(tree, node), tree["strings"])),
        let(body, whole_body),
    )
    title = find_first(nodes, lambda n: is_tag(n, "title"))
    described = find_first(nodes, lambda n: is_tag(n, "meta") & (attr(n, "name") == "description"))
    head = F.concat(
        F.when(title.isNotNull(), F.concat(F.lit("# "), strip(text_of(tree, title)), F.lit("\n\n"))).otherwise(""),
        F.when(
            described.isNotNull(),
            F.concat(strip(F.coalesce(attr(described, "content"), F.lit(""))), F.lit("\n\n")),
        ).otherwise(""),
    )
    return strip(F.concat(head, F.array_join(blocks, "")))


# --- next page, downloads, inline payloads --------------------------------------


def next_page_col(tree: Column) -> Column:
    """Raw href of the best "next page" element, if it has one."""

    def says(words):
        return lambda n: F.lower(text_of(tree, n)).contains(words)

    def last_in_pagination(n):
        return is_tag(n, "a") & n["in_pagination"] & n["is_last"]

    # Elements that lead to the next page, best first, then those that load more.
    rules = [
        lambda n: is_tag(n, "a") & (attr(n, "aria-label") == "Next"),
        lambda n: has_class(n, "next"),
        lambda n: attr_contains(n, "class", "next"),
        lambda n: is_tag(n, "a") & says("next")(n),
        lambda n: is_tag(n, "button") & says("next")(n),
        last_in_pagination,
        lambda n: is_tag(n, "a") & F.array_contains(F.split(attr(n, "rel"), r"\s+"), "next"),
        lambda n: is_tag(n, "button") & says("load more")(n),
        lambda n: has_class(n, "load-more"),
        lambda n: attr_contains(n, "class", "load-more"),
        lambda n: is_tag(n, "button") & says("show more")(n),
        lambda n: has_class(n, "more-button"),
    ]
    linked = find_all(tree["nodes"], lambda n: F.coalesce(attr(n, "href"), F.lit("")) != "")
    return F.coalesce(*[attr(find_first(linked, rule), "href") for rule in rules])


def split_binary(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(binary records, html responses), by content type."""
    kind = F.lower(F.coalesce(F.col("content_type"), F.lit("")))
    binary = contains_any(kind, BINARY_TYPES)
    records = responses.filter(binary).select(
        "url",
        "ts",
        F.lit("binary").alias("type"),
        kind.alias("content_type"),
        F.octet_length("content").cast("long").alias("size"),
        F.array().cast("array<string>").alias("links"),
    )
    return records, responses.filter(~binary)


# --- DataFrame forms ------------------------------------------------------------


def _per_page(column):
    def operator(parsed: DataFrame, name: str) -> DataFrame:
        return parsed.select("page_id", column(F.col("tree")).alias(name))

    return operator


def titles(parsed: DataFrame) -> DataFrame:
    return _per_page(title_col)(parsed, "title")


def page_text(parsed: DataFrame) -> DataFrame:
    return _per_page(page_text_col)(parsed, "text")


def headings(parsed: DataFrame) -> DataFrame:
    return _per_page(headings_col)(parsed, "headings")


def meta_map(parsed: DataFrame) -> DataFrame:
    return _per_page(meta_map_col)(parsed, "metadata")


def open_graph(parsed: DataFrame) -> DataFrame:
    return _per_page(open_graph_col)(parsed, "open_graph")


def twitter_card(parsed: DataFrame) -> DataFrame:
    return _per_page(twitter_card_col)(parsed, "twitter_card")


def json_ld(parsed: DataFrame) -> DataFrame:
    return _per_page(json_ld_col)(parsed, "json_ld")


def main_markdown(parsed: DataFrame) -> DataFrame:
    return _per_page(main_markdown_col)(parsed, "markdown")


def products(parsed: DataFrame) -> DataFrame:
    """One row per product card that has a title or a price."""
    exploded = explode_rows(parsed, ["page_id", "url"], products_col(), "product", "card_no")
    number = F.regexp_extract(F.regexp_replace("price", ",", ""), r"(\d+(?:\.\d+)?)", 1)
    return exploded.select(
        "page_id",
        "card_no",
        *[F.col("product")[name].alias(name) for name in PRODUCT_FIELDS],
        F.col("url").alias("source_url"),
    ).withColumn("price_num", number.try_cast("decimal(18,2)"))


def html_tables(parsed: DataFrame, max_cells: int | None = None, max_rows: int | None = None) -> DataFrame:
    """One row per table that holds anything; whole tables unless `max_cells` or `max_rows` bounds them."""
    tables = html_tables_col(F.col("tree"), max_cells, max_rows)
    found = explode_rows(parsed, ["page_id", "url"], tables, "content", "table_no")
    return found.select("page_id", "url", "table_no", "content.headers", "content.header_row", "content.rows")


def table_cells(parsed: DataFrame) -> DataFrame:
    """One row per data cell of every table."""
    rows = explode_rows(html_tables(parsed), ["page_id", "table_no"], F.col("rows"), "row", "row_no")
    return explode_rows(rows, ["page_id", "table_no", "row_no"], F.col("row"), "cell", "col_no")


def structured_col() -> Column:
    """JSON-LD, social cards, products and tables in one struct; a part that found nothing is NULL."""

    def used(col):
        return F.when(F.size(col) > 0, col)

    tree = F.col("tree")
    return F.struct(
        used(json_ld_col(tree)).alias("json_ld"),
        used(open_graph_col(tree)).alias("open_graph"),
        used(twitter_card_col(tree)).alias("twitter_card"),
        used(products_col()).alias("products"),
        used(html_tables_col(tree)).alias("tables"),
    )


def structured_data(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", structured_col().alias("structured")).select("page_id", "structured.*")
