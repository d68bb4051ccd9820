"""Fetch-log analytics per host.

A log has event_id, ts (timestamp), host, url, status, ok, rt. One host may hold
a large part of it, so no operator sorts or collects a whole host. Folds and the
breaker cut the ordered log into slices of a bounded number of rows and merge
their summaries; running values and gaps are windows over (host, time slice).
Results do not depend on the size of a slice, which is a parameter, and nothing
runs before the result is asked for, but for what the operators say is stored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from pageframe.functions.constants import RETRYABLE_STATUS
from pageframe.operators.asof import asof_join
from pageframe.operators.running import running_totals
from pageframe.sources.checkpoints import cut_lineage

SLICE_SECONDS = 3600.0
SLICE_ROWS = 50_000
TIMEOUT_STATUS = [408, 504]


def with_slice(log: DataFrame, slice_seconds: float = SLICE_SECONDS) -> DataFrame:
    """Adds the number of the time slice a row lies in."""
    return log.withColumn("slice", F.floor(F.unix_micros("ts") / F.lit(int(slice_seconds * 1_000_000))))


# --- retries --------------------------------------------------------------------


def retryable(log: DataFrame) -> DataFrame:
    return log.filter(F.col("status").isin(RETRYABLE_STATUS))


MAX_BACKOFF_MS = 30_000
MAX_STRATEGY_MS = 60_000
MAX_RETRY_AFTER_S = 60


def _fibonacci(limit: int) -> list[int]:
    numbers = [0, 1]
    while numbers[-1] < limit:
        numbers.append(numbers[-1] + numbers[-2])
    return numbers


def strategy_delay_ms(attempt: Column, base_ms: int, strategy: str) -> Column:
    if strategy == "exponential":
        factor = F.pow(F.lit(2.0), attempt)
    elif strategy == "linear":
        factor = attempt + 1.0
    elif strategy == "fibonacci":
        numbers = _fibonacci(MAX_STRATEGY_MS)
        last = len(numbers) - 1
        factor = F.element_at(F.array(*map(F.lit, numbers)), F.least(attempt, F.lit(last)).cast("int") + 1)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return F.least(F.lit(float(MAX_STRATEGY_MS)), factor * float(base_ms))


def retry_plan(log: DataFrame, base_ms: int = 250, strategy: str = "exponential") -> DataFrame:
    """Delay before the next try of every failed row with a 0-based `attempt` and a `retry_after` text.

    delay_ms is the doubling backoff raised by a numeric Retry-After;
    jitter_bound_ms is what a client may add; strategy_ms follows `strategy`.
    """
    backoff = F.least(F.lit(float(MAX_BACKOFF_MS)), F.pow(F.lit(2.0), F.col("attempt")) * float(max(1, base_ms)))
    asked = F.when(F.col("retry_after").rlike("^[0-9]+$"), F.col("retry_after").try_cast("bigint"))
    asked_ms = F.when(asked.isNotNull(), F.least(F.lit(MAX_RETRY_AFTER_S), asked)) * 1000.0
    planned = retryable(log).withColumns(
        {
            "delay_ms": F.greatest(backoff, asked_ms).cast("bigint"),
            "jitter_bound_ms": F.greatest(F.lit(50), F.floor(backoff * 0.2)).cast("bigint"),
            "strategy_ms": strategy_delay_ms(F.col("attempt"), base_ms, strategy).cast("bigint"),
        }
    )
    return planned.withColumn("retry_at", F.timestamp_micros(F.unix_micros("ts") + F.col("delay_ms") * 1000))


# --- totals, averages, streaks --------------------------------------------------


def host_totals(log: DataFrame) -> DataFrame:
    ok = F.col("ok")
    return log.groupBy("host").agg(
        F.count_if(ok).alias("successes"),
        F.count_if(~ok).alias("failures"),
        F.count("*").alias("total"),
        F.avg(ok.cast("double")).alias("success_rate"),
    )


class Fold(NamedTuple):
    """An ordered fold that also works piece by piece.

    `of_events` reduces the ordered `events` of a slice to a summary, `merge` an
    ordered array of summaries to one, and `finish` reads the result from it.
    """

    fields: tuple[str, ...]
    of_events: Callable[[], Column]
    merge: Callable[[Column], Column]
    finish: Callable[[Column], Column]


def _rest(items: Column) -> Column:
    return F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def _ewma_fold(keep: float) -> Fold:
    """The first value, then keep·old + (1−keep)·new, over successful fetches.

    A slice maps the average before it to decay·average + gain.
    """
    new = 1.0 - keep

    def of_events():
        good = F.transform(F.filter("events", lambda e: e["ok"]), lambda e: e["rt"])
        return F.when(
            F.size(good) > 0,
            F.struct(
                good[0].alias("first"),
                F.pow(F.lit(keep), F.size(good)).alias("decay"),
                F.aggregate(good, F.lit(0.0), lambda acc, rt: acc * F.lit(keep) + rt * F.lit(new)).alias("gain"),
            ),
        )

    def merge(parts):
        def then(a, b):
            return F.struct(
                a["first"].alias("first"),
                (a["decay"] * b["decay"]).alias("decay"),
                (a["gain"] * b["decay"] + b["gain"]).alias("gain"),
            )

        known = F.filter(parts, lambda s: s.isNotNull())
        return F.when(F.size(known) > 0, F.aggregate(_rest(known), F.get(known, F.lit(0)), then))

    return Fold(("ok", "rt"), of_events, merge, lambda s: s["first"] * s["decay"] + s["gain"])


def _streak_fold() -> Fold:
    """Current and longest run of failures."""

    def of_events():
        def add(acc, e):
            run = F.when(e["ok"], 0).otherwise(acc["run"] + 1)
            reset = acc["reset"] | e["ok"]
            return F.struct(
                run.alias("run"),
                F.greatest(acc["longest"], run).alias("longest"),
                F.when(reset, acc["head"]).otherwise(acc["head"] + 1).alias("head"),
                reset.alias("reset"),
            )

        zero = F.struct(*[F.lit(0).alias(n) for n in ("run", "longest", "head")], F.lit(False).alias("reset"))
        return F.aggregate("events", zero, add)

    def merge(parts):
        def then(a, b):
            return F.struct(
                F.when(b["reset"], b["run"]).otherwise(a["run"] + b["run"]).alias("run"),
                F.greatest(a["longest"], b["longest"], a["run"] + b["head"]).alias("longest"),
                F.when(a["reset"], a["head"]).otherwise(a["head"] + b["head"]).alias("head"),
                (a["reset"] | b["reset"]).alias("reset"),
            )

        return F.aggregate(_rest(parts), F.get(parts, F.lit(0)), then)

    return Fold(("ok",), of_events, merge, lambda s: s)


def _sum_fold(value: Callable[[Column], Column], *fields: str) -> Fold:
    def of_events():
        return F.aggregate("events", F.lit(0.0), lambda acc, e: acc + value(e))

    return Fold(fields, of_events, lambda parts: F.aggregate(parts, F.lit(0.0), lambda a, b: a + b), lambda s: s)


def _last_fold(wanted: Callable[[Column], Column], *fields: str) -> Fold:
    """Time of the last event that is wanted."""

    def of_events():
        return F.array_max(F.transform(F.filter("events", wanted), lambda e: e["ts"]))

    return Fold(fields, of_events, F.array_max, lambda s: s)


def _event_slices(log: DataFrame, slice_rows: int, *fields: str) -> DataFrame:
    """host, part, slice, events: ordered events of a host, at most `slice_rows` of them.

    Events are range-partitioned in the order (host, ts, event_id) and counted
    off in each partition, so a slice is as small for a burst or a host of a
    third of the log as for any other.
    """
    order = ["host", "ts", "event_id"]
    number = F.monotonically_increasing_id()  # counts within a partition, whose own number is in the upper bits
    placed = (
        log.select(*order, *[f for f in fields if f not in order])
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns(
            {
                "part": F.shiftright(number, 33),
                "slice": F.floor(F.pmod(number, F.lit(1 << 33)) / F.lit(slice_rows)),
            }
        )
    )
    event = F.struct("ts", "event_id", *fields)
    return placed.groupBy("host", "part", "slice").agg(F.array_sort(F.collect_list(event)).alias("events"))


def _fold_hosts(log: DataFrame, slice_rows: int, **folds: Fold) -> DataFrame:
    """One row per host with the result of every fold, from one pass over the log.

    Slices are summarised, summaries merged per host and partition, and then
    per host, from one summary a partition.
    """
    fields = dict.fromkeys(field for fold in folds.values() for field in fold.fields)
    slices = _event_slices(log, slice_rows, *fields)
    level = slices.select("host", "part", "slice", *[fold.of_events().alias(name) for name, fold in folds.items()])
    for keys, by in ((["host", "part"], "slice"), (["host"], "part")):
        pieces = level.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(by, *folds))).alias("pieces"))
        level = pieces.select(
            *keys, *[fold.merge(F.col("pieces").getField(name)).alias(name) for name, fold in folds.items()]
        )
    return level.select("host", *[fold.finish(F.col(name)).alias(name) for name, fold in folds.items()])


def _is_failure(event: Column) -> Column:
    return ~event["ok"]


def host_ewma(log: DataFrame, keep: float = 0.7, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Smoothed response time of successful fetches."""
    return _fold_hosts(log.filter("ok"), slice_rows, ewma=_ewma_fold(keep))


def host_streaks(log: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Current and longest run of failures, and the time of the last failure."""
    folded = _fold_hosts(log, slice_rows, streak=_streak_fold(), last_failure=_last_fold(_is_failure, "ok"))
    return folded.select(
        "host",
        F.col("streak.run").alias("current_streak"),
        F.col("streak.longest").alias("longest_streak"),
        "last_failure",
    )


def host_marked(
    log: DataFrame, max_streak: int = 5, max_failures: int = 3, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Hosts given up on: a failure streak or a failure total that reached its limit."""
    failures = _sum_fold(lambda e: F.when(e["ok"], 0.0).otherwise(1.0), "ok")
    folded = _fold_hosts(log, slice_rows, failures=failures, streak=_streak_fold())
    marked = folded.select(
        "host", F.col("failures").cast("bigint").alias("failures"), F.col("streak.longest").alias("longest_streak")
    )
    return marked.filter((F.col("longest_streak") >= max_streak) | (F.col("failures") >= max_failures))


# --- health ---------------------------------------------------------------------


def health_points(ok: Column, rt: Column, status: Column) -> Column:
    return (
        F.when(ok, F.lit(10.0) - rt * 0.5).when(status.isin(TIMEOUT_STATUS), F.lit(-20.0)).otherwise(F.lit(-15.0))
    )


def host_health(log: DataFrame, slice_seconds: float = SLICE_SECONDS) -> DataFrame:
    """Running health score after every event."""
    scored = with_slice(log, slice_seconds).withColumn(
        "points", health_points(F.col("ok"), F.col("rt"), F.col("status"))
    )
    return running_totals(scored, {"health": "points"}, ["host"], "slice", ["ts", "event_id"]).drop("slice", "points")


def host_healthy(
    log: DataFrame,
    as_of: str,
    min_score: float = -100.0,
    max_streak: int = 5,
    recovery_seconds: int = 300,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Score, streak and verdict of every host seen up to `as_of`."""
    moment = F.lit(as_of).cast("timestamp")
    folded = _fold_hosts(
        log.filter(F.col("ts") <= moment),
        slice_rows,
        health=_sum_fold(lambda e: health_points(e["ok"], e["rt"], e["status"]), "ok", "rt", "status"),
        streak=_streak_fold(),
        last_failure=_last_fold(_is_failure, "ok"),
    )
    since = (F.unix_micros(moment) - F.unix_micros("last_failure")) / 1e6
    resting = (F.col("streak.run") >= max_streak) & (since < recovery_seconds)
    return folded.select(
        "host",
        "health",
        F.col("streak.run").alias("current_streak"),
        ((F.col("health") >= min_score) & ~F.coalesce(resting, F.lit(False))).alias("healthy"),
    )


def host_healthy_at(
    log: DataFrame,
    instants: DataFrame,
    min_score: float = -100.0,
    max_streak: int = 5,
    recovery_seconds: int = 300,
    slice_seconds: float = SLICE_SECONDS,
) -> DataFrame:
    """`host_healthy` for every row (host, at) of `instants`, as the log stood then.

    Score and number of events run along the log; an instant takes them from
    the last event before it, and again from the last success and the last
    failure, whose numbers give the streak. Hosts not seen by then have a score
    of 0 and are healthy.
    """
    points = health_points(F.col("ok"), F.col("rt"), F.col("status"))
    scored = with_slice(log, slice_seconds).select("host", "ts", "event_id", "ok", "slice", points.alias("points"), F.lit(1).alias("one"))
    ran = running_totals(scored, {"health": "points", "n": "one"}, ["host"], "slice", ["ts", "event_id"]).withColumn("at", F.col("ts"))
    found = instants.select("host", "at")
    for events, fields in (
        (ran, {"health": "health", "n": "n"}),
        (ran.filter("ok"), {"n_ok": "n"}),
        (ran.filter("NOT ok"), {"last_failure": "ts"}),
    ):
        found = asof_join(found, events, ["host"], "at", fields, tie="event_id")
    streak = F.coalesce(F.col("n") - F.coalesce("n_ok", F.lit(0)), F.lit(0))
    since = (F.unix_micros("at") - F.unix_micros("last_failure")) / 1e6
    resting = F.coalesce((streak >= max_streak) & (since < recovery_seconds), F.lit(False))
    health = F.coalesce("health", F.lit(0.0))
    return found.select("host", "at", health.alias("health"), streak.alias("current_streak"), ((health >= min_score) & ~resting).alias("healthy"))


def host_rank(log: DataFrame, as_of: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Hosts by a composite penalty, lower is better; equal penalties share a rank.

    The penalty is rounded to six digits, which bounds the distinct penalties;
    ranks are counted over those rather than by sorting all hosts in one task.
    """
    moment = F.lit(as_of).cast("timestamp")
    seen = log.filter(F.col("ts") <= moment)
    facts = _fold_hosts(
        seen,
        slice_rows,
        successes=_sum_fold(lambda e: F.when(e["ok"], 1.0).otherwise(0.0), "ok"),
        failures=_sum_fold(lambda e: F.when(e["ok"], 0.0).otherwise(1.0), "ok"),
        streak=_streak_fold(),
        ewma=_ewma_fold(0.7),
        last_used=_last_fold(lambda e: F.lit(True)),
    )
    total = F.col("successes") + F.col("failures")
    slow = F.least(F.coalesce("ewma", F.lit(5.0)) / 5.0, F.lit(2.0))
    rate = F.when(total > 10, (F.col("successes") - F.col("failures") * 0.5) / total).otherwise(
        F.col("successes") / total
    )
    unreliable = (1.0 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate))) * 2.0
    idle = (F.unix_micros(moment) - F.unix_micros("last_used")) / 1e6
    recent = F.greatest(F.lit(0.0), (30.0 - idle) / 30.0)
    failing = F.least(F.col("streak.run") / 3.0, F.lit(1.0))
    penalty = F.round(slow * 0.4 + unreliable * 0.4 + recent * 0.1 + failing * 0.1, 6)
    # one row per host: stored, as the ranks and the result both read it
    scored = cut_lineage(facts.select("host", penalty.alias("penalty")))
    distinct = cut_lineage(scored.groupBy("penalty").agg(F.count("*").alias("n")))
    banded = distinct.withColumn("band", F.floor(F.col("penalty") * 100))
    ranks = running_totals(banded, {"upto": "n"}, [], "band", ["penalty"])
    ranks = ranks.select("penalty", (F.col("upto") - F.col("n") + 1).alias("rank"))
    return scored.join(ranks, "penalty").select("host", "penalty", "rank")


# --- adaptive delay -------------------------------------------------------------

MIN_DELAY, MAX_DELAY, SAMPLES = 0.1, 10.0, 10
_OPEN_TOP = 1e300


def _clamp_step(factor, low, high) -> Column:
    return F.struct(
        F.lit(float(factor)).alias("factor"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high")
    )


def _compose(first: Column, then: Column) -> Column:
    """Two steps of the form x -> clamp(factor·x, low, high) are one step of that form."""

    def through(x):
        return F.least(F.greatest(x * then["factor"], then["low"]), then["high"])

    return F.struct(
        (first["factor"] * then["factor"]).alias("factor"),
        through(first["low"]).alias("low"),
        through(first["high"]).alias("high"),
    )


def _last(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n)


def _from(items: Column, n: Column | int) -> Column:
    """Items from index n on."""
    start = F.lit(n) if isinstance(n, int) else n
    return F.slice(items, start + 1, F.greatest(F.size(items) - start, F.lit(0)))


def _delay_step(event: Column, window: Column) -> Column:
    """What an event does to the delay; `window` holds the last response times, its own included."""
    mean = F.aggregate(window, F.lit(0.0), lambda a, x: a + x) / SAMPLES
    full = F.size(window) >= SAMPLES
    return (
        F.when(event["status"] == 429, _clamp_step(2.0, 0.0, MAX_DELAY))
        .when(event["status"] >= 500, _clamp_step(1.5, 0.0, MAX_DELAY))
        .when(full & (mean < 0.5), _clamp_step(0.9, MIN_DELAY, _OPEN_TOP))
        .when(full & (mean > 2.0), _clamp_step(1.1, 0.0, MAX_DELAY))
        .otherwise(_clamp_step(1.0, 0.0, _OPEN_TOP))
    )


def _delay_steps(earlier: Column, events: Column) -> Column:
    """Steps of events that follow the response times `earlier`."""
    seen = F.size(earlier)

    def of(rts):  # made once, not for every event
        return F.transform(
            events,
            lambda e, i: _delay_step(
                e, F.slice(rts, F.greatest(seen + i - SAMPLES + 2, F.lit(1)), F.least(seen + i + 1, F.lit(SAMPLES)))
            ),
        )

    return F.transform(F.array(F.concat(earlier, F.transform(events, lambda e: e["rt"]))), of)[0]


def _delay_fold(initial: float) -> Fold:
    """The delay after all events.

    The step of an event looks back at nine others, so a summary keeps the first
    nine events as they are, the steps of all later ones as one step, and the
    last nine response times.
    """
    reach = SAMPLES - 1
    nothing = _clamp_step(1.0, 0.0, _OPEN_TOP)

    def head_events(events):
        return F.transform(events, lambda e: F.struct(e["rt"].alias("rt"), e["status"].alias("status")))

    def of_events():
        events = head_events(F.col("events"))
        rts = F.transform(events, lambda e: e["rt"])
        steps = _from(_delay_steps(F.array().cast("array<double>"), events), reach)
        return F.struct(
            F.slice(events, 1, reach).alias("head"),
            F.aggregate(steps, nothing, _compose).alias("body"),
            _last(rts, reach).alias("tail"),
        )

    def then(a, b):
        room = F.lit(reach) - F.size(a["head"])  # of b's first events so many join the head
        steps = _from(_delay_steps(a["tail"], b["head"]), room)
        return F.struct(
            F.slice(F.concat(a["head"], b["head"]), 1, reach).alias("head"),
            _compose(F.aggregate(steps, a["body"], _compose), b["body"]).alias("body"),
            _last(F.concat(a["tail"], b["tail"]), reach).alias("tail"),
        )

    def finish(s):
        first = F.aggregate(_delay_steps(F.array().cast("array<double>"), s["head"]), nothing, _compose)
        total = _compose(first, s["body"])
        return F.least(F.greatest(total["factor"] * initial, total["low"]), total["high"])

    def merge(parts):
        return F.aggregate(_rest(parts), F.get(parts, F.lit(0)), then)

    return Fold(("rt", "status"), of_events, merge, finish)


def host_delay(log: DataFrame, initial: float = 1.0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Politeness delay per host after its whole log.

    429 doubles it, other errors from 500 raise it by half; otherwise the mean of
    the last ten response times lowers or raises it by a tenth.
    """
    typed = log.withColumns({"rt": F.col("rt").cast("double"), "status": F.col("status").cast("int")})
    return _fold_hosts(typed, slice_rows, delay=_delay_fold(initial))


# --- cooldown -------------------------------------------------------------------


def cooldown_violations(log: DataFrame, seconds: float = 30.0, slice_seconds: float = SLICE_SECONDS) -> DataFrame:
    """Requests that came sooner than `seconds` after the one before to the same host."""
    sliced = with_slice(log, slice_seconds)
    ends = sliced.groupBy("host", "slice").agg(F.max("ts").alias("end_ts"))
    by_host = Window.partitionBy("host").orderBy("slice")
    carried = ends.select("host", "slice", F.lag("end_ts").over(by_host).alias("carried_ts"))
    in_slice = Window.partitionBy("host", "slice").orderBy("ts", "event_id")
    gaps = (
        sliced.withColumn("own_ts", F.lag("ts").over(in_slice))
        .join(carried, ["host", "slice"])
        .withColumn("gap_us", F.unix_micros("ts") - F.unix_micros(F.coalesce("own_ts", "carried_ts")))
    )
    return gaps.filter(F.col("gap_us") < int(seconds * 1_000_000)).select("event_id", "host", "ts", "gap_us")


# --- outages --------------------------------------------------------------------


class Breaker(NamedTuple):
    """State of one host: failures in a row and, when open, since when (µs)."""

    streak: int = 0
    opened_us: int | None = None


def breaker_step(state: Breaker, ts_us: int, ok: bool, threshold: int, cooldown_us: int) -> tuple[Breaker, list[str]]:
    """State after one event and the transitions it causes."""
    is_open = state.opened_us is not None
    rested = is_open and ts_us - state.opened_us >= cooldown_us
    moves = ["half_open"] if rested else []
    if ok:
        return Breaker(), moves + (["closed"] if is_open else [])
    streak = state.streak + 1
    if rested or (not is_open and streak >= threshold):
        return Breaker(streak, ts_us), moves + ["open"]
    return Breaker(streak, state.opened_us), moves


def _last_openings(times: list[int], cooldown_us: int) -> list[int]:
    """For failures only: the time of the last opening, were the breaker to open at each of them."""
    last = list(times)
    for i in reversed(range(len(times))):
        following = bisect_left(times, times[i] + cooldown_us, i + 1)
        if following < len(times):
            last[i] = last[following]
    return last


class Outage(NamedTuple):
    """What a run of events does to any state before it.

    After a success the state no longer depends on what came before. For the
    `n_tail` failures that follow, `by_position` gives the last opening by the
    position of the first one, and the `probe` lists give it by the time from
    which an open breaker may be probed (only the steps of that function are
    kept, and none beyond a cooldown after the first failure, as no probe is due
    later). So a summary holds no more than the failures of one cooldown.
    """

    reset: bool
    n_tail: int
    first_us: int | None
    by_position: list[int]
    probe_us: list[int]
    probe_exit_us: list[int]


def _steps(due_us: int, probes: list[int], exits: list[int]) -> tuple[list[int], list[int]]:
    """The probes up to the first that is due at `due_us` or later, one for each change of the exit."""
    n = min(len(probes), bisect_left(probes, due_us) + 1)
    kept = [i for i in range(n) if i + 1 == n or exits[i] != exits[i + 1]]
    return [probes[i] for i in kept], [exits[i] for i in kept]


def _summarise(times: list[int], oks: list[bool], threshold: int, cooldown_us: int) -> Outage:
    tail = times[len(oks) - oks[::-1].index(True) :] if True in oks else times
    last = _last_openings(tail, cooldown_us)
    probes, exits = _steps(tail[0] + cooldown_us, tail, last) if tail else ([], [])
    return Outage(True in oks, len(tail), tail[0] if tail else None, last[:threshold], probes, exits)


def _last_opening(opened_us: int, part: Outage, cooldown_us: int) -> int:
    at = bisect_left(part.probe_us, opened_us + cooldown_us)
    return part.probe_exit_us[at] if at < len(part.probe_us) else opened_us


def _merged(a: Outage, b: Outage, threshold: int, cooldown_us: int) -> Outage:
    """The summary of both, one after the other. Merging is associative, so runs can be merged as a tree."""
    if b.reset or not a.n_tail:
        return b._replace(reset=a.reset or b.reset)
    positions = [_last_opening(at, b, cooldown_us) for at in a.by_position] + b.by_position
    exits = [_last_opening(at, b, cooldown_us) for at in a.probe_exit_us]
    probes, exits = _steps(a.first_us + cooldown_us, a.probe_us + b.probe_us, exits + b.probe_exit_us)
    return Outage(a.reset, a.n_tail + b.n_tail, a.first_us, positions[:threshold], probes, exits)


def _after(state: Breaker, part: Outage, threshold: int, cooldown_us: int) -> Breaker:
    if part.reset:
        state = Breaker()
    streak = state.streak + part.n_tail
    if state.opened_us is not None:
        return Breaker(streak, _last_opening(state.opened_us, part, cooldown_us))
    if streak >= threshold and part.n_tail:
        return Breaker(streak, part.by_position[threshold - 1 - state.streak])
    return Breaker(streak)


def _states_before(state: Breaker, parts: list[dict], threshold: int, cooldown_us: int) -> list[dict]:
    states = []
    for part in parts:
        states.append({"node": part["node"], "streak": state.streak, "opened_us": state.opened_us})
        state = _after(state, Outage(**part["summary"]), threshold, cooldown_us)
    return states


def _moves(events: list[dict], state: Breaker, threshold: int, cooldown_us: int) -> list[dict]:
    found = []
    for event in events:
        state, moves = breaker_step(state, event["ts_us"], event["ok"], threshold, cooldown_us)
        found += [
            {"event_id": event["event_id"], "ts_us": event["ts_us"], "step": i, "state": move}
            for i, move in enumerate(moves)
        ]
    return found


TRANSITION_DDL = "host string, event_id long, ts_us long, step int, state string"
_SUMMARY = pa.struct(
    [
        ("reset", pa.bool_()),
        ("n_tail", pa.int64()),
        ("first_us", pa.int64()),
        ("by_position", pa.list_(pa.int64())),
        ("probe_us", pa.list_(pa.int64())),
        ("probe_exit_us", pa.list_(pa.int64())),
    ]
)
_STATES = pa.list_(pa.struct([("node", pa.int64()), ("streak", pa.int64()), ("opened_us", pa.int64())]))
_MOVES = pa.list_(
    pa.struct([("event_id", pa.int64()), ("ts_us", pa.int64()), ("step", pa.int32()), ("state", pa.string())])
)
#: What a slice of a stream does: failures before its first success, that success, the moves after it, the state at the end.
EFFECT = pa.struct(
    [
        ("failed_us", pa.list_(pa.int64())),
        ("failed_id", pa.list_(pa.int64())),
        ("ok_us", pa.int64()),
        ("ok_id", pa.int64()),
        ("moves", _MOVES),
        ("streak", pa.int64()),
        ("opened_us", pa.int64()),
    ]
)


def slice_effect(events: list[dict], threshold: int, cooldown_us: int) -> dict:
    """The effect of ordered events (ts_us, event_id, ok), as fields of EFFECT."""
    first = next((i for i, event in enumerate(events) if event["ok"]), len(events))
    state, moves = Breaker(), []
    for event in events[first + 1 :]:
        state, steps = breaker_step(state, event["ts_us"], event["ok"], threshold, cooldown_us)
        moves += [{"event_id": event["event_id"], "ts_us": event["ts_us"], "step": i, "state": m} for i, m in enumerate(steps)]
    success = events[first] if first < len(events) else {"ts_us": None, "event_id": None}
    return {
        "failed_us": [event["ts_us"] for event in events[:first]],
        "failed_id": [event["event_id"] for event in events[:first]],
        "ok_us": success["ts_us"],
        "ok_id": success["event_id"],
        "moves": moves,
        "streak": state.streak,
        "opened_us": state.opened_us,
    }


def after_effect(state: Breaker, effect: dict, threshold: int, cooldown_us: int) -> tuple[Breaker, list[tuple]]:
    """State after a slice and its transitions (event_id, ts_us, step, state); openings are found by binary search."""
    times, ids, moves = effect["failed_us"], effect["failed_id"], []
    opened, at = state.opened_us, 0
    if opened is None and state.streak + len(times) >= threshold:
        at = threshold - state.streak
        opened = int(times[at - 1])
        moves.append((int(ids[at - 1]), opened, 0, "open"))
    while opened is not None and (at := bisect_left(times, opened + cooldown_us, at)) < len(times):
        opened = int(times[at])
        moves += [(int(ids[at]), opened, 0, "half_open"), (int(ids[at]), opened, 1, "open")]
        at += 1
    if effect["ok_us"] is None:
        return Breaker(state.streak + len(times), opened), moves
    if opened is not None:
        ends = ["half_open", "closed"] if effect["ok_us"] - opened >= cooldown_us else ["closed"]
        moves += [(effect["ok_id"], effect["ok_us"], i, move) for i, move in enumerate(ends)]
    moves += [(m["event_id"], m["ts_us"], m["step"], m["state"]) for m in effect["moves"]]
    return Breaker(effect["streak"], effect["opened_us"]), moves


#: Children of a node of the tree of summaries, as a power of two.
FAN_BITS = 8


def _states_of_slices(summaries: DataFrame, levels: int, fan_bits: int, limits: tuple[int, int]) -> DataFrame:
    """host, node, streak, opened_us: the state before each of (host, node, summary).

    Summaries are merged up a tree, `2 ** fan_bits` nodes into one, and the
    states are handed down it, so no task sees more than that of a host.
    """

    def merge(groups: pa.Array) -> pa.Array:
        merged = []
        for group in groups.to_pylist():
            total, *rest = [Outage(**child["summary"]) for child in group]
            for part in rest:
                total = _merged(total, part, *limits)
            merged.append(total._asdict())
        return pa.array(merged, _SUMMARY)

    def states(groups: pa.Array, streak: pa.Array, opened: pa.Array) -> pa.Array:
        rows = zip(groups.to_pylist(), streak.to_pylist(), opened.to_pylist(), strict=True)
        return pa.array([_states_before(Breaker(n, at), group, *limits) for group, n, at in rows], _STATES)

    families, level = [], summaries
    for _ in range(max(1, levels)):
        children = F.array_sort(F.collect_list(F.struct("node", "summary"))).alias("children")
        families.append(level.groupBy("host", F.shiftright("node", fan_bits).alias("parent")).agg(children))
        level = families[-1].select("host", F.col("parent").alias("node"), _arrow_udf(merge, _SUMMARY)("children").alias("summary"))
    start = {"streak": F.lit(0).cast("long"), "opened_us": F.lit(None).cast("long")}
    known = families[-1].withColumns(start)  # one family a host
    while True:
        before = F.explode(_arrow_udf(states, _STATES)("children", "streak", "opened_us")).alias("b")
        nodes = known.select("host", before).select("host", "b.*")
        families.pop()
        if not families:
            return nodes
        known = families[-1].join(nodes.withColumnRenamed("node", "parent"), ["host", "parent"])


def _arrow_udf(function: Callable, returns: pa.DataType) -> Callable[..., Column]:
    return F.arrow_udf(function, from_arrow_type(returns))


def breaker_timeline(
    log: DataFrame,
    threshold: int = 10,
    cooldown_seconds: float = 30.0,
    slice_rows: int = SLICE_ROWS,
    fan_bits: int = FAN_BITS,
) -> DataFrame:
    """Transitions of a per-host breaker: open after `threshold` failures in a row, probed after the cooldown.

    The ordered log is cut into slices of bounded rows (`_event_slices`), which
    are stored. Each becomes a summary; the states before the slices come from a
    tree of merged summaries; then each slice tells its own transitions.
    """
    limits = (threshold, int(cooldown_seconds * 1_000_000))

    def summarise(times: pa.Array, oks: pa.Array) -> pa.Array:
        rows = zip(times.to_pylist(), oks.to_pylist(), strict=True)
        return pa.array([_summarise(t, ok, *limits)._asdict() for t, ok in rows], _SUMMARY)

    def moves(events: pa.Array, streak: pa.Array, opened: pa.Array) -> pa.Array:
        rows = zip(events.to_pylist(), streak.to_pylist(), opened.to_pylist(), strict=True)
        return pa.array([_moves(e, Breaker(n, at), *limits) for e, n, at in rows], _MOVES)

    slices = cut_lineage(_event_slices(log.withColumn("ts_us", F.unix_micros("ts")), slice_rows, "ts_us", "ok"))
    parts, most = slices.agg(F.max("part"), F.max("slice")).first()
    levels = [-(-int(n or 0).bit_length() // fan_bits) for n in (most, parts)]
    node = F.shiftleft("part", levels[0] * fan_bits) + F.col("slice")
    slices = slices.withColumn("node", node).drop("part", "slice")
    summary = _arrow_udf(summarise, _SUMMARY)(F.transform("events", lambda e: e["ts_us"]), F.transform("events", lambda e: e["ok"]))
    before = _states_of_slices(slices.select("host", "node", summary.alias("summary")), sum(levels), fan_bits, limits)
    found = _arrow_udf(moves, _MOVES)(
        F.transform("events", lambda e: F.struct(e["event_id"], e["ts_us"], e["ok"])), "streak", "opened_us"
    )
    joined = slices.join(before, ["host", "node"])
    return joined.select("host", F.explode(found).alias("m")).select("host", "m.*")
