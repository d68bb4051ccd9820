"""Extractors on hand-written pages."""

import random

from pyspark.sql import functions as F

from pageframe.functions import text as T
from pageframe.operators import pages as P
from pageframe.operators import records as R


def test_title(parse, values):
    pages = parse(
        "<title>A &amp; B</title><title>second</title>",
        "<title></title>",
        "<title>a<b>c</b></title>",
        "<title><b>only</b></title>",
        "<p>none</p>",
    )
    assert values(P.titles(pages), "title") == ["A & B", None, None, "only", ""]


def test_headings(parse, values):
    got = values(P.headings(parse("<h2> b </h2><h1>a<i>!</i></h1><h2>c</h2><h7>x</h7>")), "headings")
    assert got == [{"h1": ["a!"], "h2": ["b", "c"]}]


def test_metadata(parse, values):
    html = (
        "<meta name=k content=1><meta name=k content=2><meta property=p content=v><meta name='' property=q content=w>"
        "<meta name=none><meta property=og:a content=x><meta property=og:b><meta name=twitter:c content=y>"
    )
    pages = parse(html)
    assert values(P.meta_map(pages), "metadata") == [
        {"k": "2", "p": "v", "q": "w", "og:a": "x", "twitter:c": "y"}
    ]
    assert values(P.open_graph(pages), "open_graph") == [{"og:a": "x", "og:b": None}]
    assert values(P.twitter_card(pages), "twitter_card") == [{"twitter:c": "y"}]


def test_json_ld(parse, values):
    html = (
        "<script type='application/ld+json'>{\"b\": [1, 2]}</script><script type='application/ld+json'>{</script>"
        "<script type='application/json'>{}</script><script type='application/ld+json'></script>"
    )
    assert values(P.json_ld(parse(html)), "json_ld") == [['{"b":[1,2]}']]


def product(**fields):
    return dict.fromkeys(P.PRODUCT_FIELDS) | fields


def products(parse, html):
    rows = P.products(parse(html)).orderBy("card_no").collect()
    return [{name: row[name] for name in P.PRODUCT_FIELDS} for row in rows]


def test_first_card_rule_wins(parse):
    html = "<div class='item'><h1>no</h1></div><div class='thumbnail'><h1>yes</h1></div>"
    assert products(parse, html) == [product(title="yes")]


def test_nested_cards_are_both_kept(parse):
    html = "<div class=item><h2>out</h2><div class=item><h2>in</h2></div></div>"
    assert [p["title"] for p in products(parse, html)] == ["out", "in"]


def test_title_stops_at_first_rule_and_falls_back_to_its_attribute(parse):
    html = "<div class=item><a class=title title=' T '> </a><h1>later</h1></div>"
    assert products(parse, html)[0]["title"] == "T"


def test_price_needs_a_dollar_or_digits(parse):
    def price(inner):
        found = products(parse, f"<div class=item><h1>t</h1>{inner}</div>")
        return found[0]["price"]

    assert price("<b class=price>call us</b><b class=cost>$ 5</b>") == "$ 5"
    assert price("<b class=price>1,299.50</b>") == "1,299.50"
    assert price("<b class=price>12 EUR</b>") is None
    assert price("<div class=caption><h4>$7</h4></div><h4>$8</h4>") == "$7"


def test_description_is_longer_than_ten(parse):
    html = "<div class=item><h1>t</h1><p class=description>1234567890</p><p>12345678901</p></div>"
    # the first <p> is the short one: a rule looks at its first element only
    assert products(parse, html)[0]["description"] is None
    html = "<div class=item><h1>t</h1><p class=description>1234567890</p><i class=specs>12345678901</i></div>"
    assert products(parse, html)[0]["description"] == "12345678901"


def test_reviews_image_and_link(parse):
    html = "<div class=item><h1>t</h1><p class=ratings>4</p><small>9 Reviews</small><img><a name=x>n</a></div>"
    assert products(parse, html) == [product(title="t", reviews="9 Reviews", image="", url="")]


def test_caption_may_enclose_the_card(parse):
    html = "<div class=caption><div class=item><b>x</b><h4>$3</h4></div></div>"
    assert products(parse, html)[0]["price"] == "$3"


def test_cards_without_title_and_price_are_dropped(parse):
    assert products(parse, "<div class=item><p>long enough text</p></div>") == []


def test_tables(parse):
    rows = "".join(f"<tr><td>{i}</td></tr>" for i in range(15))
    html = (
        f"<table><tr><th> a </th></tr>{rows}</table><table></table><table><tr><td>x</td></tr></table>"
        "<table><tr><td>o<table><tr><td>i</td></tr></table></td></tr></table>"
    )
    found = P.html_tables(parse(html)).orderBy("table_no").collect()
    assert [t.headers for t in found] == [["a", *map(str, range(15))], ["x"], ["oi", "i"], ["i"]]
    assert [t.header_row for t in found] == [["a"], ["x"], ["oi", "i"], ["i"]]
    assert found[0].rows == [[str(i)] for i in range(15)]
    cut = P.html_tables(parse(html), max_cells=10, max_rows=10).orderBy("table_no").first()
    assert cut.headers == ["a", *map(str, range(9))] and cut.rows == [[str(i)] for i in range(10)]
    assert found[2].rows == [["i"]]


def test_markdown(parse, values):
    pages = parse(
        "<title>T</title><meta name=description content=D><nav><p>n</p></nav><main><h2>H</h2><p>p</p>"
        "<ul><li>a</li></ul><pre><code>c</code></pre></main>",
        "<title>T</title><body><p>x<span class=nav>gone</span>y</p><footer><p>f</p></footer></body>",
        "<div>no body</div>",
    )
    assert values(P.main_markdown(pages), "markdown") == [
        "# T\n\nD\n\n## H\n\np\n\n- a\n```\nc\n```\n\n```\nc\n```",
        "# T\n\nxy",
        None,
    ]


def test_clean_text(spark):
    html = "<p>a  b</p><style>x</style><script>y</script> caf&eacute; 東京 #é̀ (1.5) &lt;tag"
    rows = spark.createDataFrame([(html,)], "t string")
    assert rows.select(T.clean_text(F.col("t"))).first()[0] == "a b café 東京 é (1.5) tag"
    assert rows.select(T.clean_text(F.col("t"), enabled=False)).first()[0] == html


def test_keywords(spark):
    rows = spark.createDataFrame([("Data data DATA été 42",)], "t string")
    got = rows.select(T.keyword_matches(F.col("t"), ["data", r"\w+té", 42, 43])).first()[0]
    assert got == ["42", "DATA", "Data", "data", "été"]


def test_bad_keyword_fails_before_a_job(spark):
    import pytest

    for pattern in ("(", "(?P<n>x", "(?(1)a|b)"):
        with pytest.raises(ValueError, match="not a pattern"):
            T.keyword_matches(F.col("t"), [pattern])


def test_named_groups_of_keywords(spark):
    df = spark.createDataFrame([("n7 nn É é",)], "t string")
    found = df.select(T.keyword_matches(F.col("t"), [r"(?P<a_b>n)(?P=a_b)", r"n(?P<d>\d+)", "é"]).alias("k")).first().k
    assert found == ["n7", "nn", "É", "é"]


def test_next_page(parse, values):
    pages = parse(
        "<a href=/1 rel=next>x</a><a href=/2>Next</a>",
        "<i class=next>no link</i><a class=x-next href=/3>n</a>",
        "<div class=pagination><a href=/4>1</a><a href=/5>2</a></div>",
        "<p>none</p>",
    )
    assert values(pages.select("page_id", P.next_page_col(F.col("tree")).alias("n")), "n") == ["/2", "/3", "/5", None]


def test_download_candidates(parse):
    html = (
        "<a href=x.PDF>file</a><a href=/save><b>Save</b> it</a><i download href=/d>i</i><a href=/y.pdf?v=1>y</a>"
        "<a href=/DOWNLOADS>z</a><a href=/none>n</a><a href=x.PDF#again>Download</a>"
    )
    found = {r.url.rsplit("/", 1)[1]: r.strategy for r in R.download_candidates(parse(html), ["pdf"]).collect()}
    assert found == {"x.PDF": 1, "save": 1, "d": 2, "y.pdf?v=1": 2, "DOWNLOADS": 4}


def test_inline_payloads(parse):
    html = (
        "<section><div><code>first</code></div><button onclick=\"a.download = 'f.mdc'; blob()\">go</button></section>"
        "<section><p><button x-on:click=\"blob($refs.out)\">save notes.txt, now</button></p></section>"
        "<pre></pre><span x-ref=out>ref text</span><button onclick=\"x.textContent='inline'; download()\">k</button>"
        "<button onclick='other()'>n</button>"
    )
    rows = R.inline_payloads(parse(html)).orderBy("node_id").collect()
    assert [(r.file_name, r.content) for r in rows] == [
        ("f.mdc", "first"),
        ("notes.txt", "ref text"),
        ("downloaded_file.txt", "first"),
    ]
    decoded = R.decode_payloads(R.inline_payloads(parse(html))).orderBy("node_id").collect()
    assert decoded[0].file_name == "f.md" and bytes(decoded[0].content) == b"first"


def near(nodes, strings, node, tag, with_own):
    """Text of a `tag` node near another, by looking at every sibling and all that is below it."""

    def below(outer):
        return next((n for n in nodes if outer and outer.node_id < n.node_id <= outer.end_id and n.tag == tag), None)

    siblings = [n for n in nodes if n.parent_id == node.parent_id and n is not node]
    parent = nodes[node.parent_id] if node.parent_id >= 0 else None
    grandparent = nodes[parent.parent_id] if parent and parent.parent_id >= 0 else None
    sides = [[n for n in siblings if n.node_id < node.node_id], [n for n in siblings if n.node_id > node.node_id]]
    found = [next((below(n) for n in side if below(n)), None) for side in sides] + [below(parent), below(grandparent)]
    for place in found + [below(node)] * with_own:
        text = "".join(strings[place.s0 : place.s1]) if place else ""
        if text.strip():
            return text
    return None


def test_payloads_of_random_pages_against_a_loop(parse):
    rng = random.Random(5)

    def inner(depth):
        kinds = ["div", "p", "code", "pre", "button", "text"] if depth < 5 else ["text"]
        out = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.choice(kinds)
            mark = " onclick='blob()'" if kind == "button" else ""
            out.append(rng.choice(["", f"w{rng.randrange(99)}"]) if kind == "text" else f"<{kind}{mark}>{inner(depth + 1)}</{kind}>")
        return "".join(out)

    parsed = parse(*[inner(0) for _ in range(60)])
    trees = {r.page_id: r.tree for r in parsed.select("page_id", "tree").collect()}
    rows = R.inline_payloads(parsed).collect()
    assert len(rows) == sum(n.tag == "button" for tree in trees.values() for n in tree.nodes) > 50
    for r in rows:
        tree = trees[r.page_id]
        node = tree.nodes[r.node_id]
        want = near(tree.nodes, tree.strings, node, "code", True) or near(tree.nodes, tree.strings, node, "pre", False)
        assert r.content == want or (want is None and r.content.startswith("# "))


def test_pages_of_many_links_and_buttons(parse):
    """Work that grew with the square of a page's links or buttons would not end here."""
    links = "".join(f"<p><a href=/f{i % 15_000}.pdf>download</a></p>" for i in range(20_000))
    assert R.download_candidates(parse(links), ["pdf"]).count() == 15_000
    buttons = "<code>c</code>" + "<p><i>x</i><b>y</b><button onclick='blob()'>a.txt</button></p>" * 5_000 + "<div>z</div>" * 30_000
    rows = R.inline_payloads(parse(buttons)).select("file_name").distinct().collect()
    assert [r.file_name for r in rows] == ["a.txt"]


def test_binary_split(spark):
    rows = [("u1", "Image/PNG", b"123"), ("u2", "text/html", b"x"), ("u3", None, b"")]
    df = spark.createDataFrame(rows, "url string, content_type string, content binary").selectExpr(
        "*", "timestamp'2024-01-01' AS ts"
    )
    binary, rest = P.split_binary(df)
    assert [(r.url, r.type, r.size, r.links) for r in binary.collect()] == [("u1", "binary", 3, [])]
    assert rest.count() == 2


def test_page_records(spark):
    html = "<title>T</title><h1>H</h1><a href='/x#f'>a &amp; b</a><script>call('/api/v1/items')</script>"
    pages = spark.createDataFrame([(1, "https://h.example.com/p", html)], "page_id long, url string, html string")
    row = R.page_records(pages, "2024-02-01 00:00:00", ["a"], find_apis=True).collect()[0]
    assert (row.title, row.text, row.keywords) == ("T", "THa  b", ["a"])
    assert row.links == ["https://h.example.com/x"] and row.headings == {"h1": ["H"]}
    assert "https://h.example.com/api/v1" in row.api_endpoints
    assert row.structured.products is None
