"""Links and URLs, checked against the standard library."""

from urllib.parse import urldefrag, urljoin

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageframe.functions import urls as U
from pageframe.operators import links as L
from pageframe.operators import url_filters as UF
from pageframe.plans import recipes as X

BASES = ["https://w.example.com/a/b/c?z=1#top", "http://h.example.com", "https://h.example.com/d/", "http://h/x//y/z"]
RAWS = [
    "../x", "./y", "z?q#f", "//host/p", "//host", "?q", "?", "", "a b/c", "é/ü", "/r/../s", "/../x", "..", ".", "../..",
    "../../../..", "x/./y/../z", "x/..", "/x/.", "/a//b", "a//b", "http://o/p#f", "https://o/p?", "https://o", "HTTP://o/p",
    "http:rel", "https:rel", "http:/abs", "x;y=1", ";p", "x?a=/../b", "/p#", " /sp ", "\t/t\n", "/a\nb", "x#y?z", "..x", "x..",
    "https://o/a/../b", "//o/../b", "/.hidden", "./", "../", "ftp://h/x", "#f", "javascript:x", "mailto:a", "data:x", "tel:1",
]


def expected(base, raw):
    raw = raw.strip()
    if not raw or raw.startswith(U.SKIPPED_PREFIXES):
        return None
    url = urldefrag(urljoin(base, raw))[0]
    return url if url.startswith(("http://", "https://")) else None


def resolved(spark, pairs):
    df = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(pairs)], "i int, b string, r string")
    got = df.select("i", U.resolve_one(U.url_struct(F.col("b")), F.col("r")).alias("u")).orderBy("i").collect()
    return [row.u for row in got]


def test_resolution_matches_urljoin(spark):
    pairs = [(b, r) for b in BASES for r in RAWS]
    wrong = [(p, got, expected(*p)) for p, got in zip(pairs, resolved(spark, pairs)) if got != expected(*p)]
    assert wrong == []


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="./?#ab:", min_size=1, max_size=9), min_size=150, max_size=300))
def test_random_references_match_urljoin(spark, raws):
    raws = [r for r in raws if not r.startswith((":", "//")) and "://" not in r]
    pairs = [(BASES[0], r) for r in raws]
    wrong = [(p, got, expected(*p)) for p, got in zip(pairs, resolved(spark, pairs)) if got != expected(*p)]
    assert wrong == []


def test_resolved_links_resolve_to_themselves(spark):
    urls = [u for u in resolved(spark, [(b, r) for b in BASES for r in RAWS]) if u and not u.endswith("?")]
    assert resolved(spark, [(BASES[0], u) for u in urls]) == urls


def test_kinds_add_up_to_page_links(parse):
    html = (
        "<a href=/1></a><i onclick=\"document.location='/2'\" data-src=/3></i><link href=/4><iframe src=/5></iframe>"
        "<img src=/6 srcset='/7 1x, , /8 2x'><script src=/9>x('http://o/10')</script><audio src=/11><source src=/12></audio>"
        "<source src=/no><meta http-equiv=refresh content='0;url=\"/13\"'><base href=/14><base href=/no2>"
    )
    pages = parse(html)
    by_kind = {(r.link_kind, r.url) for r in L.links(pages).collect()}
    assert {u for _, u in by_kind} == {r.url for r in L.page_links(pages).collect()}
    assert {u.rsplit("/", 1)[1] for _, u in by_kind} == {str(i) for i in range(1, 15)}
    one_by_one = {(r.link_kind, r.url) for kind in L.LINK_KINDS for r in L.links(pages, [kind]).collect()}
    assert one_by_one == by_kind


def test_base_resolves_only_on_request(parse):
    pages = parse("<base href='/base/'><a href=x></a>")
    assert [r.url for r in L.links(pages, ["anchor"]).collect()] == ["https://w.example.com/a/b/x"]
    assert [r.url for r in L.links(pages, ["anchor"], honor_base=True).collect()] == ["https://w.example.com/base/x"]


def test_links_need_no_shuffle(parse):
    plan = L.links(parse("<a href=x>"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1  # the spreading of a tiny input


def column(spark, values, make):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.r for r in df.select("i", make(F.col("v")).alias("r")).orderBy("i").collect()]


def test_extensions(spark):
    urls = ["http://h/.env", "http://h/a.tar.gz", "http://h/X.PDF", "http://h/r.mdc", "http://h/n", "http://h/d.x/", "http://h/a.b?c.d"]
    assert column(spark, urls, U.url_extension) == ["", "gz", "pdf", "md", "", "", "b"]


@pytest.mark.parametrize(
    ("url", "extensions", "exclude", "expected"),
    [
        ("http://h/a.PDF", [".pdf"], None, True),
        ("http://h/a.pdf", ["pdf"], ["PDF"], False),
        ("http://h/a.pdf", None, None, False),
        ("http://h/a", ["pdf"], None, False),
        ("file:///t/a.mdc", ["md"], None, True),
        ("file:///t/a.txt", ["md"], None, False),
        ("file:///t/a", ["md"], None, True),
        ("file:///t/a.txt", None, None, True),
        ("blob:n.md:aGk=", ["md"], None, True),
        ("blob:n.txt:aGk=", ["md"], None, False),
    ],
)
def test_downloadable(spark, url, extensions, exclude, expected):
    assert column(spark, [url], lambda c: UF.is_downloadable(c, extensions, exclude)) == [expected]
    assert column(spark, [url], lambda c: UF.is_downloadable(c, extensions, crawl_only=True)) == [False]


def test_valid_urls(spark):
    urls = [
        "https://s/a/p.html", "https://s/a/x.css", "https://s/a/x.pdf", "https://s/b/x.pdf", "https://s/b/q", "https://t/a/q",
        "https://s/a/q#f", "https://s/a/q", "https://s/a/i.png", "mailto:x@s",
    ]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url for r in UF.valid_urls(df, "s", "/a", ["pdf"]).collect()}
    assert got == {"https://s/a/x.pdf", "https://s/b/x.pdf", "https://s/a/q"}
    got = {r.url for r in UF.valid_urls(df, "s", dump_all=True).collect()}
    assert got == {u for u in urls if u.startswith("https://s/") and "#" not in u}


def test_names(spark):
    assert column(spark, ["https://h:80/a/ü b/"], U.site_folder) == ["h_80_a_ü_b"]
    assert column(spark, ["mailto:"], U.site_folder) == ["site_download"]
    shown = column(spark, ["https://h/r/x", "https://h/r", "https://h/o", "https://h"], lambda c: U.display_url(c, "https://h/r/"))
    assert shown == ["/x", "/", "/o", "/"]

    def name(kind=None, disposition=None):
        return lambda c: U.artifact_name(c, F.lit(kind).cast("string"), F.lit(disposition).cast("string"))

    assert column(spark, ["https://h/a b.mdc?x"], name()) == ["ab.md"]
    assert column(spark, ["https://h/n"], name("text/plain")) == ["n.md"]
    assert column(spark, ["https://h/"], name()) == ["downloaded_file.bin"]
    assert column(spark, ["https://h/n.x"], name(None, 'a; filename="r 1.md"')) == ["r1.md"]
    url = "https://h/" + "x" * 300 + ".pdf"
    key = column(spark, [url], U.url_key)[0]
    assert column(spark, [url], name()) == ["x" * 179 + "_" + key[:16] + ".pdf"]


@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["f", "f_1", "f_2", "f_1_1", "g_", "_1", ".h"]), st.sampled_from([".html", "", ".x", "/"])), max_size=25))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_paths_are_unique(spark, parts):
    urls = sorted({f"https://{h}{i}.x/{name}{ext}" for i, (h, name, ext) in enumerate(parts)})
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = UF.assign_paths(df).collect()
    assert len({r.stored_path for r in rows}) == len(rows) == len(urls)
    assert {r.path for r in rows} <= {r.stored_path for r in rows}


def test_natural_names_are_left_to_their_urls(spark):
    urls = ["https://a.x/f.html", "https://b.x/f.html", "https://a.x/f_1.html", "https://c.x/f.html", "https://a.x/f_3.html"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r.stored_path for r in UF.assign_paths(df).collect()}
    assert sorted(got.values()) == ["f.html", "f_1.html", "f_2.html", "f_3.html", "f_4.html"]
    assert got["https://a.x/f_1.html"] == "f_1.html" and got["https://a.x/f_3.html"] == "f_3.html"


def test_paths_of_a_hot_group_are_distinct(spark):
    df = spark.range(3000).selectExpr("'https://h' || id || '/same/f.txt' AS url")
    paths = [r.stored_path for r in UF.assign_paths(df).collect()]
    assert set(paths) == {"same/f.txt", *(f"same/f_{i}.txt" for i in range(1, 3000))}


def test_links_are_told_apart_as_strings(parse):
    """Structs have no hash here: their distinct compares every two references of a page."""
    html = "".join(f"<a href='/p q/{i % 9}'>x</a><img src='/p q/{i % 7}'>" for i in range(60)) + "<a href=' '>x</a>"
    found = L.links(parse(html))
    rows = [(r.link_kind, r.url) for r in found.collect()]
    site = "https://w.example.com/p q/"
    assert rows == [("anchor", f"{site}{i}") for i in range(9)] + [("img", f"{site}{i}") for i in range(7)]
    expressions = found._jdf.queryExecution().analyzed().toString()
    # the struct is made once, from strings that are distinct already
    assert expressions.count("struct(link_kind,") == 1


def test_pages_are_rendered_in_many_tasks(spark):
    """A table of few columns is one partition of a scan, however many pages are rendered from it."""
    for pages in (X.link_pages, X.relative_pages, X.download_pages, X.next_pages):
        rendered = pages(spark, "/root/testdata/sf0.001")
        assert rendered.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert rendered.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
