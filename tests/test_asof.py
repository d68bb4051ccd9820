"""As-of joins against a loop."""

import random
from datetime import datetime, timedelta

import pytest

from pageframe.operators import host_log as H
from pageframe.operators.asof import asof_join

START = datetime(2024, 1, 1)
ROWS = "k string, at timestamp, id long, v double"


def at(second):
    return None if second is None else START + timedelta(seconds=second)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_asof_join_against_a_loop(spark, partitions):
    rng = random.Random(6)
    right = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(400), i, float(i)) for i in range(900)] + [("a", None, 5000, 1.0)]
    left = [(rng.choice(["hot", "a", "b", "none", None]), rng.choice([*range(-5, 420), None]), i, "x") for i in range(500)]
    left += left[:3]
    want = []
    for key, second, i, text in left:
        before = [r for r in right if key is not None and second is not None and r[1] is not None and r[0] == key and r[1] <= second]
        last = max(before, key=lambda r: (r[1], r[2]), default=None)
        want.append((key, at(second), i, text, last and last[3], last and last[2]))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        a = spark.createDataFrame([(k, at(s), i, t) for k, s, i, t in left], "k string, at timestamp, id long, v string").repartition(3)
        b = spark.createDataFrame([(k, at(s), i, v) for k, s, i, v in right], ROWS).repartition(4)
        got = asof_join(a, b, ["k"], "at", {"value": "v", "number": "id"}, tie="id").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
        empty = asof_join(a, b.limit(0), ["k"], "at", {"value": "v"})
        assert empty.count() == len(left) and empty.filter("value IS NOT NULL").count() == 0
        assert asof_join(a.limit(0), b, ["k"], "at", {"value": "v"}).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_healthy_at_equals_healthy_at_each_instant(spark):
    rng = random.Random(8)
    rows = [(i, at(rng.randrange(3600)), rng.choice("ab"), "u", rng.choice([200, 503, 504]), rng.random() < 0.4, rng.random()) for i in range(300)]
    log = spark.createDataFrame(rows, "event_id long, ts timestamp, host string, url string, status int, ok boolean, rt double")
    instants = [at(s) for s in (-10, 700, 1800, 9000)]
    asked = spark.createDataFrame([(h, t) for h in ("a", "b", "c") for t in instants], "host string, at timestamp")
    got = {(r.host, r.at): (round(r.health, 6), r.current_streak, r.healthy) for r in H.host_healthy_at(log, asked, -400.0, 2, 900).collect()}
    for t in instants:
        then = {r.host: (round(r.health, 6), r.current_streak, r.healthy) for r in H.host_healthy(log, str(t), -400.0, 2, 900).collect()}
        for host in ("a", "b", "c"):
            assert got[host, t] == then.get(host, (0.0, 0, True))
