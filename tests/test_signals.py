"""Signals, checked against Python's own regular expressions."""

import re

from pyspark.sql import functions as F

from pageframe.functions.constants import API_PATTERNS, SECRET_PATTERNS
from pageframe.operators import pages as P
from pageframe.operators import signals as G
from pageframe.operators import url_filters as UF

TEXTS = [
    "go('/api/v2/users') and /Search?q=é/get-é_x wss://s.example.com/a/b.c x/ws /users/ /user",
    "ends in /ws",
    "ends in /auth\n",
    "see https://h.example.com/data/file.json?x=1 or rel.csv? then /v1/x/v2/y",
    "no slash at all but .xml",
    "a" * 5000 + "/token",
    "",
]


def brute(text):
    found = set()
    for pattern in API_PATTERNS:
        if pattern.startswith(r"\."):
            found |= set(re.findall(rf"(?<![\w./:?-])[\w./:?-]*?{pattern}", text, re.I))
        else:
            found |= set(re.findall(pattern, text, re.I))
    return found


def test_api_matches_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    for row in df.select("t", G.api_matches_col(F.col("t")).alias("m")).collect():
        assert set(row.m) == brute(row.t), row.t


def test_api_paths_keep_sockets_and_first_page(spark):
    rows = [(2, "https://h/a/", "/api/x"), (1, "https://h/b/", "/api/x wss://s/t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.api_url: (r.first_page_id, r.n_pages) for r in G.api_paths(pages).collect()}
    assert found == {"https://h/api/x": (1, 2), "wss://s/t": (1, 1)}


VALUE = "Ab0_" * 6


def test_secrets_never_leave_as_text(spark):
    text = f"x API_KEY = '{VALUE}' y, \"X-API-Key\": \"short\", token: {VALUE}"
    df = spark.createDataFrame([(1, text), (2, "nothing"), (3, text)], "doc_id long, text string")
    found = G.secret_findings(df).collect()
    assert len(found) == 1 and found[0].prefix == "Ab0_" and found[0].length == 24 and found[0].first_id == 1
    assert VALUE not in str(found)
    assert VALUE not in str(G.redact_secrets(df).collect())
    assert "short" in G.redact_secrets(df).filter("doc_id = 1").first().text


def test_gate_lets_every_pattern_through():
    for _, lead, _ in SECRET_PATTERNS:
        assert re.search(G._SECRET_GATE, re.sub(r"\[_-\]\?|\\s|[\[\]\"'?*+:=\\]", "", lead)), lead


def test_render_marks(parse):
    pages = parse(
        "<script src=/React.js></script>",
        "<div id=__next></div>",
        "<head>" + "<script></script>" * 4 + "</head><body>short<script></script></body>",
        "<body>" + "<script></script>" * 9 + "short</body>",
        "<p ng-version=1>",
        "Please WAIT",
        "<meta name=generator content='Next.js'>",
        "<p>plain</p>",
        keep=("html",),
    )
    rows = G.render_class(pages).orderBy("page_id").collect()
    marks = ["framework_script", "app_root", "little_text", None, "hydration", "challenge", "generator", None]
    for row, mark in zip(rows, marks):
        assert [m for m in marks if m and row[m]] == ([mark] if mark else [])
        assert row.needs_render == (mark is not None)


def test_dynamic_score(spark):
    html = "<noscript></noscript> x.onload = 1; document.write(2)"
    rows = [(1, "https://h/p", html), (2, "https://h/p", "<noscript>"), (3, "https://h/p", "x" * 600 + "<noscript>"), (4, "https://h/ajax", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.score, r.needs_dynamic) for r in G.dynamic_score(pages).collect()}
    assert got == {1: (3, True), 2: (1, True), 3: (1, False), 4: (0, True)}
    links = spark.createDataFrame([(1, "https://h/f.pdf")], "page_id long, url string")
    settled = G.dynamic_score(pages, UF.pages_with_targets(links, ["pdf"]))
    assert not settled.filter("page_id = 1").first().needs_dynamic


def test_challenge_pages_are_dropped(spark):
    pages = spark.createDataFrame([(1, "u", "Just a MOMENT"), (2, "u", "ok")], "page_id long, url string, html string")
    assert [r.page_id for r in G.drop_challenge_pages(pages).collect()] == [2]
    assert P.parse_pages(G.drop_challenge_pages(pages)).count() == 1
