"""Host analytics against plain Python over the same rows, whatever the slice length."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pageframe.operators import host_log as H

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SLICES = [7, 60, 100_000]
ROWS = [1, 4, 13, 50_000]


@pytest.fixture(scope="module")
def rows():
    """Four hosts; "hot" has most rows, and long outages."""
    rng = random.Random(5)
    out, moment = [], START
    for i in range(1500):
        moment += timedelta(seconds=rng.choice([0, 1, 2, 5, 20]))
        host = rng.choice(["hot"] * 7 + ["a", "b", "c"])
        down = (i // 200) % 2 == 1
        status = rng.choice([503, 504, 429, 200] if down else [200, 200, 200, 500])
        out.append((i, moment, host, f"u{i % 9}", status, status == 200, round(rng.random() * 4, 3)))
    return out


@pytest.fixture(scope="module")
def log(spark, rows):
    ddl = "event_id long, ts timestamp, host string, url string, status int, ok boolean, rt double"
    return spark.createDataFrame(rows, ddl).repartition(5).cache()


@pytest.fixture(scope="module")
def by_host(rows):
    hosts = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[1], r[0])):
        hosts[row[2]].append(row)
    return hosts


@pytest.mark.parametrize("size", ROWS)
def test_ewma(log, by_host, size):
    for row in H.host_ewma(log, slice_rows=size).collect():
        average = None
        for r in by_host[row.host]:
            if r[5]:
                average = r[6] if average is None else average * 0.7 + r[6] * 0.3
        assert row.ewma == pytest.approx(average)


@pytest.mark.parametrize("size", ROWS)
def test_streaks(log, by_host, size):
    for row in H.host_streaks(log, size).collect():
        run = longest = 0
        for r in by_host[row.host]:
            run = 0 if r[5] else run + 1
            longest = max(longest, run)
        assert (row.current_streak, row.longest_streak) == (run, longest)


@pytest.mark.parametrize("seconds", SLICES)
def test_health(log, by_host, seconds):
    got = {r.event_id: r.health for r in H.host_health(log, seconds).collect()}
    assert len(got) == 1500
    for events in by_host.values():
        score = 0.0
        for r in events:
            score += 10 - 0.5 * r[6] if r[5] else -20 if r[4] in (408, 504) else -15
            assert got[r[0]] == pytest.approx(score)


@pytest.mark.parametrize("size", ROWS)
def test_delay(log, by_host, size):
    for row in H.host_delay(log, slice_rows=size).collect():
        delay, recent = 1.0, []
        for r in by_host[row.host]:
            recent = (recent + [r[6]])[-10:]
            if r[4] == 429:
                delay = min(delay * 2, 10.0)
            elif r[4] >= 500:
                delay = min(delay * 1.5, 10.0)
            elif len(recent) == 10 and sum(recent) / 10 < 0.5:
                delay = max(delay * 0.9, 0.1)
            elif len(recent) == 10 and sum(recent) / 10 > 2.0:
                delay = min(delay * 1.1, 10.0)
        assert row.delay == pytest.approx(delay)


@pytest.mark.parametrize("seconds", SLICES)
def test_cooldown(log, by_host, seconds):
    got = {r.event_id: r.gap_us for r in H.cooldown_violations(log, 3.0, seconds).collect()}
    want = {}
    for events in by_host.values():
        for before, after in zip(events, events[1:]):
            gap = (after[1] - before[1]) // timedelta(microseconds=1)
            if gap < 3_000_000:
                want[after[0]] = gap
    assert got == want


def timeline(events, threshold, cooldown_us):
    state, moves = H.Breaker(), []
    for r in events:
        ts_us = (r[1] - START) // timedelta(microseconds=1) + int(START.timestamp()) * 1_000_000
        state, steps = H.breaker_step(state, ts_us, r[5], threshold, cooldown_us)
        moves += [(r[2], r[0], ts_us, i, s) for i, s in enumerate(steps)]
    return moves


@pytest.mark.parametrize(("slice_rows", "fan_bits"), [(1, 1), (7, 2), (50_000, 8)])
@pytest.mark.parametrize(("threshold", "cooldown"), [(1, 0.0), (3, 10.0), (10, 30.0), (4, 500.0)])
def test_breaker_does_not_depend_on_slices(log, by_host, slice_rows, fan_bits, threshold, cooldown):
    got = {tuple(r) for r in H.breaker_timeline(log, threshold, cooldown, slice_rows, fan_bits).collect()}
    want = {m for events in by_host.values() for m in timeline(events, threshold, int(cooldown * 1e6))}
    assert got == want and want


def test_building_starts_no_job(spark, log):
    spark.sparkContext.setJobGroup("build", "build")
    for make in (H.host_ewma, H.host_streaks, H.host_marked, H.host_health, H.host_delay, H.cooldown_violations):
        make(log)
    H.host_healthy(log, "2024-02-01 00:00:00")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("build")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_burst_is_cut_into_slices(spark):
    """All events of a host in one second: no slice holds more rows than asked for, and results stay."""
    burst = spark.range(20_000).selectExpr(
        "id AS event_id", "timestamp_micros(1704067200000000 + id) AS ts", "'hot' AS host", "'u' AS url",
        "case when id % 1000 = 7 then 200 else 503 end AS status", "id % 1000 = 7 AS ok", "0.25D AS rt",
    ).repartition(4)
    row = H.host_streaks(burst, 500).first()
    assert (row.current_streak, row.longest_streak) == (992, 999)
    plan = H.host_streaks(burst, 500)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(" in plan
    assert H.host_delay(burst, slice_rows=500).first().delay == 10.0


GAPS = st.lists(st.tuples(st.integers(0, 12), st.sampled_from([False, False, False, True])), min_size=1, max_size=40)


@settings(max_examples=1500, deadline=None)
@given(GAPS, st.integers(1, 30), st.integers(1, 4), st.integers(0, 40))
def test_slice_summaries_compose(gaps, length, threshold, cooldown):
    now, slices = 0, defaultdict(list)
    for gap, ok in gaps:
        now += gap
        slices[now // length].append((now, ok))
    stepped = folded = H.Breaker()
    for number in sorted(slices):
        times, oks = map(list, zip(*slices[number]))
        folded = H._after(folded, H._summarise(times, oks, threshold, cooldown), threshold, cooldown)
        for ts, ok in slices[number]:
            stepped, _ = H.breaker_step(stepped, ts, ok, threshold, cooldown)
        assert folded == stepped


@settings(max_examples=1500, deadline=None)
@given(GAPS, st.lists(st.integers(0, 40), min_size=2, max_size=2), st.integers(1, 4), st.integers(0, 40))
def test_merging_summaries_is_associative(gaps, cuts, threshold, cooldown):
    """Of three runs in a row, merged either way, the effect on every state is that of the events."""
    times, oks, now = [], [], 100
    for gap, ok in gaps:
        now += gap
        times.append(now)
        oks.append(ok)
    first, second = sorted(cuts)
    limits = (threshold, cooldown)
    runs = [(times[a:b], oks[a:b]) for a, b in ((0, first), (first, second), (second, len(times)))]
    x, y, z = [H._summarise(*run, *limits) for run in runs]
    left, right = H._merged(H._merged(x, y, *limits), z, *limits), H._merged(x, H._merged(y, z, *limits), *limits)
    closed = [H.Breaker(n) for n in range(threshold)]
    opened = [H.Breaker(9, at) for at in range(times[0] - 60, times[0] + 1)]
    for state in closed + opened:
        stepped = state
        for ts, ok in zip(times, oks):
            stepped, _ = H.breaker_step(stepped, ts, ok, *limits)
        assert H._after(state, left, *limits) == H._after(state, right, *limits) == stepped
    assert len(left.probe_us) <= sum(ts <= left.first_us + cooldown for ts in times) + 1 if left.n_tail else not left.probe_us


def test_breaker_of_a_host_of_a_third_of_the_log(spark):
    """A burst of failures of one host in a second, among others: many slices, a tree of levels, equal transitions."""
    events = spark.range(30_000).selectExpr(
        "id AS event_id", "timestamp_micros(1704067200000000 + id * 50) AS ts", "if(id % 3 = 0, 'hot', 'h' || id % 100) AS host", "'u' AS url",
        "503 AS status", "id % 1500 = 9 OR id % 7 = 1 AND id % 3 > 0 AS ok", "0.25D AS rt",
    ).repartition(4)
    rows = [tuple(r) for r in events.orderBy("ts").collect()]
    by_host = defaultdict(list)
    for r in rows:
        by_host[r[2]].append(r)
    got = {tuple(r) for r in H.breaker_timeline(events, 5, 0.01, slice_rows=200, fan_bits=2).collect()}
    state_moves = set()
    for host, own in by_host.items():
        state = H.Breaker()
        for r in own:
            us = 1704067200000000 + r[0] * 50
            state, moves = H.breaker_step(state, us, r[5], 5, 10_000)
            state_moves |= {(host, r[0], us, i, m) for i, m in enumerate(moves)}
    assert got == state_moves and sum(m[0] == "hot" for m in got) > 50


def test_breaker_story():
    state, seen = H.Breaker(), []
    for ts, ok in [(0, False), (1, False), (5, False), (12, False), (13, True), (14, False), (15, False), (40, True)]:
        state, moves = H.breaker_step(state, ts, ok, 2, 10)
        seen.append(moves)
    assert seen == [[], ["open"], [], ["half_open", "open"], ["closed"], [], ["open"], ["half_open", "closed"]]


def test_rank_shares_places(spark):
    rows = [(i, START, f"h{i % 3}", "u", 200, True, 1.0 + (i % 3 == 2)) for i in range(3)]
    log = spark.createDataFrame(rows, "event_id long, ts timestamp, host string, url string, status int, ok boolean, rt double")
    got = {r.host: r["rank"] for r in H.host_rank(log, "2024-01-02 00:00:00").collect()}
    assert got == {"h0": 1, "h1": 1, "h2": 3}


def test_healthy_recovers(log, by_host):
    late = H.host_healthy(log, "2025-01-01 00:00:00", min_score=-1e9).collect()
    assert all(r.healthy for r in late) and len(late) == len(by_host)


def test_retry_after(spark):
    rows = [(i, START, "h", "u", 429, False, 1.0, 2, after) for i, after in enumerate(["2", "500", "x", None, "0"])]
    ddl = "event_id long, ts timestamp, host string, url string, status int, ok boolean, rt double, attempt int, retry_after string"
    plan = H.retry_plan(spark.createDataFrame(rows, ddl), 250).orderBy("event_id").collect()
    assert [r.delay_ms for r in plan] == [2000, 60_000, 1000, 1000, 1000]
    assert {r.jitter_bound_ms for r in plan} == {200}


def test_no_operator_collects_a_whole_host(log):
    """A plan that sorts by host alone would put a hot host in one task."""
    for df in (H.host_health(log), H.cooldown_violations(log)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(host" in plan and "slice" in plan
