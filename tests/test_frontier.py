"""Dataflow operators against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from pageframe.operators import frontier as Fr
from pageframe.operators.running import first_rows


def bfs(edges, seeds, max_depth, max_urls=None, allowed=lambda u: True):
    seen = {}
    level = sorted({s for s in seeds if allowed(s)})
    for depth in range(max_depth + 1):
        if max_urls is not None:
            level = level[: max_urls - len(seen)]
        seen |= dict.fromkeys(level, depth)
        level = sorted({d for s, d in edges if s in set(level) and allowed(d)} - set(seen))
    return seen


@pytest.fixture(scope="module")
def graph():
    rng = random.Random(3)
    edges = [(f"/p/{rng.randrange(60)}", f"/p/{rng.randrange(60)}") for _ in range(90)]
    return edges + [("/p/0", f"/hub/{i}") for i in range(300)] + [(f"/hub/{i}", "/p/7") for i in range(300)]


@pytest.mark.parametrize(("max_depth", "max_urls"), [(0, None), (2, None), (12, None), (3, 5), (3, 150), (3, 1)])
def test_frontier_equals_bfs(spark, graph, max_depth, max_urls):
    edges = spark.createDataFrame(graph, "src string, dst string")
    seeds = spark.createDataFrame([("/p/0",), ("/p/1",), ("/p/0",)], "url string")
    got = Fr.crawl_frontier(edges, seeds, max_depth, max_urls, exclude=["/p/13"], salt_edges=100)  # /p/0 gets three salts
    rows = [(r.url, r.depth) for r in got.collect()]
    assert len(rows) == len(set(u for u, _ in rows))
    assert dict(rows) == bfs(graph, ["/p/0", "/p/1"], max_depth, max_urls, lambda u: "/p/13" not in u)


def test_a_level_does_not_move_what_is_visited(spark):
    rows = [(f"u{i}",) for i in range(100)]
    name = Fr._bucketed(spark.createDataFrame(rows, "url string"), 4, "url")
    try:
        new = spark.createDataFrame(rows[50:] + [("new",)], "url string")
        left = Fr.unvisited(new, spark.table(name))
        assert [r.url for r in left.collect()] == ["new"]
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(url") <= 2 and "Broadcast" not in plan
        scan = plan[plan.rindex("SortMergeJoin") :].split("FileScan")[1]
        assert "Bucketed: true" in scan or "Bucketed: true" in plan
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_a_deep_crawl_is_compared_with_few_runs(spark, monkeypatch):
    """A chain: as many anti joins a level as the logarithm of its depth, not as its depth."""
    joins, plain = [], Fr.unvisited
    monkeypatch.setattr(Fr, "unvisited", lambda urls, visited: joins.append(1) or plain(urls, visited))
    edges = spark.createDataFrame([(f"/p/{i:02}", f"/p/{j:02}") for i in range(14) for j in (i + 1, 0)], "src string, dst string")
    got = Fr.crawl_frontier(edges, spark.createDataFrame([("/p/00",)], "url string"), 14, buckets=2)
    assert {(r.url, r.depth) for r in got.collect()} == {(f"/p/{i:02}", i) for i in range(15)}
    assert len(joins) <= sum(d.bit_length() for d in range(1, 15)) < sum(range(15)) / 2
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("pageframe_")]


def test_frontier_leaves_no_table(spark, graph):
    edges = spark.createDataFrame(graph, "src string, dst string")
    Fr.crawl_frontier(edges, spark.createDataFrame([("/p/0",)], "url string")).count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("pageframe_")]


def test_frontier_of_nothing(spark):
    edges = spark.createDataFrame([], "src string, dst string")
    seeds = spark.createDataFrame([("x",)], "url string")
    assert [tuple(r) for r in Fr.crawl_frontier(edges, seeds).collect()] == [("x", 0)]


def test_duplicates_and_order(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 2), ("a", 9)], "url string, seq int")
    assert {(r.url, r.seq, r.status) for r in Fr.mark_duplicates(df).collect()} == {
        ("a", 2, "start"), ("a", 3, "duplicate"), ("a", 9, "duplicate"), ("b", 1, "start"),
    }
    once = Fr.dedup_urls(df.withColumnRenamed("seq", "depth"))
    assert {tuple(r) for r in once.collect()} == {("a", 2), ("b", 1)} == {tuple(r) for r in Fr.dedup_urls(once).collect()}


def test_keep_newest(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("a", 4)], "k string, t int")
    assert [r.k for r in Fr.keep_newest(df, 2, "k", "t").collect()] == ["c", "b"]
    assert [r.k for r in Fr.keep_newest(df, 2, "k", "t", touch=True).collect()] == ["a", "c"]


def test_endpoints(spark):
    lines = [
        "http://1.2.3.4:80/x", "HTTPS://h.example:443", "socks5://h.example:1080", "socks://h.example:1081",
        "h.example:99999", "h.example:0", "ab:80", "noport", "h.example:x", "h.example:80:81", "h.example:8080",
    ]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    got = {(r.endpoint, r.kind) for r in Fr.clean_endpoints(df).collect()}
    assert got == {
        ("1.2.3.4:80", "http"), ("h.example:1080", "socks5"), ("h.example:1081", "socks5"), ("h.example:8080", "http"),
    }


def test_first_match_and_union(spark):
    hits = spark.createDataFrame([(1, 2, 5, "x"), (1, 1, 9, "z"), (1, 1, 7, "y")], "p int, rank int, node int, v string")
    assert [tuple(r) for r in Fr.first_match(hits, ["p"], "rank", "node", "v").collect()] == [(1, "y", 1)]
    other = spark.createDataFrame([(2, True)], "p int, extra boolean")
    assert Fr.collect_pages(hits, other, other).count() == 5


@pytest.mark.parametrize("n", [0, 1, 77, 400, 401])
def test_first_rows_by_range(spark, n):
    df = spark.range(400).selectExpr("(id * 7919) % 401 AS v").repartition(6)
    small = [r.v for r in df.orderBy(F.desc("v")).limit(n).collect()]
    assert sorted(r.v for r in first_rows(df, n, F.desc("v")).collect()) == sorted(small)
