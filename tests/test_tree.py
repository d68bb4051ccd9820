"""Tree rules on hand-written markup."""

import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageframe.functions import html_tree
from pageframe.functions.html_tree import _TreeReader
from pageframe.operators import pages as P


def tree(html):
    reader = _TreeReader().read(html)
    return [(t, p, e) for t, p, e in zip(reader.tags, reader.parents, reader.ends)], reader


def test_open_paragraphs_nest():
    nodes, _ = tree("<p>a<p>b</p>c")
    assert nodes == [("p", -1, 1), ("p", 0, 1)]


def test_end_tag_closes_up_to_its_element_and_stray_ones_are_ignored():
    nodes, reader = tree("<div><b>x<i>y</div></b>z")
    assert nodes == [("div", -1, 2), ("b", 0, 2), ("i", 1, 2)]
    assert reader.strings == ["x", "y", "z"]


def test_void_self_closing_and_upper_case():
    nodes, reader = tree("<DIV CLASS=Big hidden><br></br><img SRC='a'><p/>t</DIV>")
    assert nodes == [("div", -1, 3), ("br", 0, 1), ("img", 0, 2), ("p", 0, 3)]
    assert reader.attrs[0] == {"class": "Big", "hidden": ""}


def test_script_text_is_raw_and_hidden():
    nodes, reader = tree("<div>a<script>var t='</p><a href=x>';</script>b</div>")
    assert [n[0] for n in nodes] == ["div", "script"]
    assert reader.raws[1] == "var t='</p><a href=x>';"
    assert reader.strings == ["a", "b"]


def test_comments_split_strings_and_blank_strings_shrink():
    _, reader = tree("<p>a<!-- x -->b</p>   \n\t <pre>  \n </pre><b>   </b>")
    assert reader.strings == ["a", "b", "\n", "  \n ", " "]
    assert reader.children[0] == 3


def test_references_are_resolved_once():
    _, reader = tree("<p>&amp;lt; &eacute;&#233;&nbsp;</p>")
    assert reader.strings == ["&lt; éé\xa0"]


def test_deep_nesting_stays_linear():
    _, reader = tree("<p>x" * 20_000)
    assert len(reader.tags) == 20_000 and len(reader.strings) == 20_000
    assert reader.ends[0] == 19_999


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<a>", "</a>", "<b>", "</b>", "<br>", "t", "<p/>", "</div>", "<div>", "<!-- -->"])))
def test_ranges_nest(parts):
    _, reader = tree("".join(parts))
    for node, parent in enumerate(reader.parents):
        assert reader.ends[node] >= node
        assert reader.starts[node] <= reader.stops[node]
        if parent >= 0:
            assert parent < node <= reader.ends[node] <= reader.ends[parent]
            assert reader.starts[parent] <= reader.starts[node] <= reader.stops[node] <= reader.stops[parent]
            assert reader.depths[node] == reader.depths[parent] + 1


PIECES = [
    "<a>", '<a href="/x">', '<a href="/x" id="q" id="r">', "<a href=/x>", "<A HREF='y'>", '<a href="a&amp;b">', "</a>", "</A>", "</a >",
    "<script>", "</script>", "<style>", "</style>", "<p>", "</p", "<br/>", '<img src="x"/>', "<", ">", "&", "&lt;", "t", "\n", "<!--", "-->",
    "<pre>", "</pre>", "<title>", "</title>", '<b data-x="1">', '<b c="<">', "<!DOCTYPE html>", "<?pi>", "<template>", "</template>",
]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_plain_tags_read_like_any_others(pieces):
    html = "".join(pieces)
    quick = _TreeReader().read(html)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(html_tree, "PLAIN_START", re.compile(r"(?!)"))
        patch.setattr(html_tree, "PLAIN_END", re.compile(r"(?!)"))
        general = _TreeReader().read(html)
    assert (quick.rows, quick.strings) == (general.rows, general.strings)


@pytest.mark.parametrize("html", [None, "", "<![bad", "no tags", "<div"])
def test_odd_pages_parse(parse, html):
    row = parse(html).collect()[0]
    assert row.tree.nodes == [] or len(row.tree.nodes) <= 1


def test_five_megabytes_on_one_line(parse):
    html = "<p>" + "word " * 1_000_000 + "</p>"
    row = parse(html).select(F.length(P.page_text_col(F.col("tree"))).alias("n")).collect()[0]
    assert row.n == 5_000_000


def test_nodes_rows(parse):
    rows = {r.tag: r for r in P.to_nodes(parse("<div class=' a  b '><p>x</p>y</div>")).collect()}
    assert rows["div"].classes == ["a", "b"] and rows["div"].text == "xy" and rows["p"].parent_id == 0


def test_one_parse_per_page(parse):
    plan = P.products(parse("<p>x</p>"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


def test_marks_equal_a_search_of_all_nodes():
    import random
    import re

    rng = random.Random(9)
    classes = ["caption", "x caption", "pagination", "nav", "a\tfooter", "captions", ""]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(40)):
            tag = rng.choice(["div", "p", "a", "nav", "br", "header", "body"])
            name = rng.choice(classes)
            parts.append(rng.choice([f'<{tag} class="{name}">', f"</{tag}>", "text "]))
        page = _TreeReader().read("".join(parts))
        n = len(page.tags)
        names = [set(re.split(r"\s+", a.get("class", ""))) for a in page.attrs]

        def around(i, wanted):
            return any(j < i <= page.ends[j] and wanted in names[j] for j in range(n))

        def is_chrome(j):
            return page.tags[j] in ("nav", "header") or bool(names[j] & {"navbar", "nav", "header", "footer"})

        for i in range(n):
            assert page.captions[i] == around(i, "caption") and page.paginations[i] == around(i, "pagination")
            assert page.lasts[i] == (not any(page.parents[j] == page.parents[i] for j in range(i + 1, n)))
            assert page.chromes[i] == max((j for j in range(i + 1) if i <= page.ends[j] and is_chrome(j)), default=-1)
        for s, chrome in enumerate(page.string_chrome):
            assert chrome == max((j for j in range(n) if page.starts[j] <= s < page.stops[j] and is_chrome(j)), default=-1)


def test_a_batch_is_read_in_parts_of_bounded_bytes():
    pages = pa.array(["<p>" + "x" * 1000 + "</p>"] * 5000 + [None, "", "<b>y</b>", "<i>" + "z" * 3_000_000 + "</i>"])
    parts = list(html_tree.parts_of(pages))
    assert max(part.nbytes for part in parts[:-1]) < 2 << 20 and len(parts[-1]) == 1
    trees = list(html_tree._read_parts(iter([pages, pages.slice(0, 0)])))
    assert max(map(len, trees)) < 1100 and sum(map(len, trees)) == len(pages)
    assert pa.concat_arrays(trees).equals(html_tree._read_trees(pages))


def test_pages_reach_python_in_batches_of_bounded_bytes(spark):
    from pageframe.sources import readers

    before = spark.conf.get(readers.BATCH_SETTING)
    try:
        spark.conf.set(readers.BATCH_SETTING, "64m")
        pages = spark.range(0, 3000, 1, 1).selectExpr("id AS page_id", "'u' AS url", "repeat('x', 10000) AS html")
        assert P.parse_pages(pages).count() == 3000

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

        largest = pages.select("html").mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
        assert largest < 2 * readers.BATCH_BYTES
        for limit in ("1000000b", "3m"):
            spark.conf.set(readers.BATCH_SETTING, limit)
            P.parse_pages(pages)
            assert spark.conf.get(readers.BATCH_SETTING) == limit
    finally:
        spark.conf.set(readers.BATCH_SETTING, before)
