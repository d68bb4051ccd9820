"""Event streams: ingest, live counts, enrichment, outage alerts, sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from pageframe.operators.host_log import EFFECT, TRANSITION_DDL, Breaker, after_effect, breaker_timeline, slice_effect
from pageframe.sources.readers import EVENT_DDL, MANIFEST_DDL

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_events(
    spark: SparkSession, folder: str, keys: list[str], schema: str = EVENT_DDL, late: str = "1 hour"
) -> DataFrame:
    """Event lines as a stream; repeats of `keys` within the watermark are dropped."""
    lines = spark.readStream.schema(schema).json(folder)
    return lines.filter(F.col("ts").isNotNull()).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def stream_progress(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events per type and time window, tumbling or sliding; rows behind the watermark are dropped.

    In append mode a window appears when the watermark has closed it, in update mode (`write_versions`) at once.
    """
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = events.withWatermark("ts", late).groupBy(window.alias("w"), "event").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event", "n")


def _sessions_of_batches(key: str, gap_us: int, tick_us: int, schema: pa.Schema) -> Callable:
    """Arrow batches of (key, us) as rows of events that follow each other within a tick."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas().sort_values([key, "us"])
            near = (rows[key] == rows[key].shift()) & (rows["us"].diff() < min(gap_us, tick_us)) & (
                rows["us"] // tick_us == rows["us"].shift() // tick_us
            )
            runs = rows.groupby((~near).cumsum())
            out = runs.agg(**{key: (key, "first"), "first_us": ("us", "min"), "last_us": ("us", "max"), "n": ("us", "size")})
            out["seen"] = pd.to_datetime(out["last_us"], unit="us", utc=True)
            yield pa.RecordBatch.from_pandas(out, schema, preserve_index=False)

    return run


class SessionProcessor(StatefulProcessor):
    """Open sessions of one key, by start; a timer drops what the watermark has closed."""

    def __init__(self, key: str, gap_us: int):
        self.key, self.gap_us = key, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first_us array<long>, last_us array<long>, n array<long>")

    def _known(self) -> list[tuple[int, int, int]]:
        return list(zip(*self.open.get(), strict=True)) if self.open.exists() else []

    def _keep(self, sessions: list[tuple[int, int, int]], watermark_ms: int) -> None:
        still = [s for s in sessions if s[1] + self.gap_us > watermark_ms * 1000]
        if still:
            self.open.update(tuple(list(column) for column in zip(*still, strict=True)))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self._known()
        fresh = pd.concat(rows)[["first_us", "last_us", "n"]]
        merged: list[tuple[int, int, int]] = []
        for first, last, n in sorted(before + list(fresh.itertuples(index=False, name=None))):
            if merged and first - merged[-1][1] < self.gap_us:
                start, end, count = merged.pop()
                first, last, n = start, max(end, last), count + n
            merged.append((int(first), int(last), int(n)))
        changed = sorted(set(merged) - set(before))
        starts = {first for first, _, _ in merged}
        gone = [(first, first, 0) for first, _, _ in before if first not in starts]
        for _, last, _ in changed:
            self.handle.registerTimer(-(-(last + self.gap_us) // 1000))
        self._keep(merged, timerValues.getCurrentWatermarkInMs())
        out = pd.DataFrame(changed + gone, columns=["start_us", "end_us", "n"])
        out["end_us"] += self.gap_us
        out.insert(0, self.key, key[0])
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._known(), timerValues.getCurrentWatermarkInMs())
        yield from ()

    def close(self) -> None:
        pass


def stream_sessions(
    events: DataFrame, key: str, gap_seconds: float, late: str = "1 hour", tick_seconds: float = 1.0
) -> DataFrame:
    """Events per session of a key, in update mode: (key, start, end, n); less than a gap apart is one session.

    A row is a new version of the session that starts there. n is 0 where a
    session has become part of an earlier one, so `write_versions` and
    `read_versions` with the filter n > 0 have every event once. The state holds
    a key's open sessions alone: a timer drops a session when the watermark has
    passed its end. Events of a key within a tick travel as one row, so a busy
    key is reduced before its state sees it; such a row is late if its last event
    is. Events without a time are left out.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    gap_us, tick_us = int(gap_seconds * 1_000_000), max(1, int(tick_seconds * 1_000_000))
    key_type = events.schema[key].dataType
    rows = events.filter("ts IS NOT NULL").select(key, F.unix_micros("ts").alias("us"))
    longs = [(name, pa.int64()) for name in ("first_us", "last_us", "n")]
    schema = pa.schema([(key, to_arrow_type(key_type)), *longs, ("seen", pa.timestamp("us", "UTC"))])
    ddl = f"`{key}` {key_type.simpleString()}, first_us long, last_us long, n long, seen timestamp"
    ticks = rows.mapInArrow(_sessions_of_batches(key, gap_us, tick_us, schema), ddl).withWatermark("seen", late)
    sessions = ticks.groupBy(key).transformWithStateInPandas(
        statefulProcessor=SessionProcessor(key, gap_us),
        outputStructType=f"`{key}` {key_type.simpleString()}, start_us long, end_us long, n long",
        outputMode="Update",
        timeMode="EventTime",
    )
    return sessions.select(key, F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"), "n")


def stream_enrich(
    events: DataFrame,
    manifest: DataFrame,
    before: str = "0 seconds",
    after: str = "1 hour",
    late: str = "1 hour",
) -> DataFrame:
    """Finished downloads with path and type from the manifest lines (url, ts, path, content_type) of their URL.

    Both sides are streams, so the manifest may grow: a line counts from
    `before` ahead of the download to `after` behind it, one row for each. A
    download without one appears when the watermark has passed that range, and
    nothing stays in the state for longer. `enrich_rest` has those that still
    wait when the log ends.
    """
    done = events.filter("event = 'download_complete'").withWatermark("ts", late)
    lines = manifest.select(
        F.col("url").alias("line_url"), F.col("ts").alias("line_ts"), "path", "content_type"
    ).withWatermark("line_ts", late)
    here = F.expr(f"url = line_url AND line_ts >= ts - INTERVAL {before} AND line_ts <= ts + INTERVAL {after}")
    return done.join(lines, here, "left_outer").drop("line_url", "line_ts")


def enrich_rest(events: DataFrame, told: DataFrame, key: str = "event_id") -> DataFrame:
    """Downloads that `stream_enrich` has not told of when both logs have ended: those still waiting for a line."""
    done = events.filter("event = 'download_complete'")
    waiting = done.join(told.select(key).distinct(), key, "left_anti")
    return waiting.withColumns({name: F.lit(None).cast(told.schema[name].dataType) for name in ("path", "content_type")})


def packed(effect: dict) -> bytes:
    """An effect as compact JSON: a batch may hold all slices of a host, and as objects one takes some kilobytes."""
    return json.dumps([effect[name] for name in EFFECT.names], separators=(",", ":")).encode()


def unpacked(effect: bytes) -> dict:
    return dict(zip(EFFECT.names, json.loads(effect), strict=True))


class OutageProcessor(StatefulProcessor):
    """Breaker of one host, fed with what closed time slices do (`slice_effect`); a slice costs a few binary searches."""

    def __init__(self, threshold: int, cooldown_us: int):
        self.limits = (threshold, cooldown_us)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.breaker = handle.getValueState("breaker", "streak long, opened_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slices = pd.concat(rows).sort_values("start_us")
        state = Breaker(*self.breaker.get()) if self.breaker.exists() else Breaker()
        found = []
        for effect in slices["effect"]:
            state, moves = after_effect(state, unpacked(effect), *self.limits)
            found += [(key[0], *move) for move in moves]
        self.breaker.update(tuple(state))
        yield pd.DataFrame(found, columns=["host", "event_id", "ts_us", "step", "state"])

    def close(self) -> None:
        pass


def stream_breaker(
    log: DataFrame,
    threshold: int = 10,
    cooldown_seconds: float = 30.0,
    late: str = "1 hour",
    slice_length: str = "10 seconds",
) -> DataFrame:
    """The transitions of `breaker_timeline` as a stream.

    Events are gathered and ordered per host and time slice, so a busy host is
    spread over many tasks. There a slice becomes its effect: the failures up to
    its first success, and the transitions after it, which no earlier event can
    change. The state of a host sees one effect per slice, once the watermark has
    closed it. `breaker_rest` has the slices that are open when the log ends.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    limits = (threshold, int(cooldown_seconds * 1_000_000))

    def effects(slices: pa.Array) -> pa.Array:
        # one slice at a time as Python objects; an effect stays packed until its host's breaker takes it
        return pa.array([packed(slice_effect(events.as_py(), *limits)) for events in slices], pa.binary())

    event = F.struct(F.unix_micros("ts").alias("ts_us"), "event_id", "ok")
    slices = (
        log.withWatermark("ts", late)
        .groupBy("host", F.window("ts", slice_length).alias("w"))
        .agg(F.array_sort(F.collect_list(event)).alias("events"))
        .select("host", F.unix_micros("w.start").alias("start_us"), F.arrow_udf(effects, "binary")("events").alias("effect"))
    )
    return slices.groupBy("host").transformWithStateInPandas(
        statefulProcessor=OutageProcessor(*limits),
        outputStructType=TRANSITION_DDL,
        outputMode="Append",
        timeMode="None",
    )


def breaker_rest(
    log: DataFrame,
    threshold: int = 10,
    cooldown_seconds: float = 30.0,
    late: str = "1 hour",
    slice_length: str = "10 seconds",
) -> DataFrame:
    """What `stream_breaker` has not told after it took in all of `log`: transitions in slices that are still open.

    A batch pass over each host's events from its last success before those
    slices on, as a success leaves no state. The stream tells the same rows
    itself when later events close the slices, unless it dropped late ones.
    """
    seen = log.filter("ts IS NOT NULL")
    watermark = F.date_trunc("millisecond", F.max("ts")) - F.expr(f"INTERVAL {late}")
    ends = seen.agg(watermark.alias("at")).select(F.window("at", slice_length)["start"].alias("open_from"))
    marked = seen.crossJoin(F.broadcast(ends))  # one row
    last = marked.filter("ok AND ts < open_from").groupBy("host").agg(F.max("ts").alias("last_ok"))
    needed = marked.join(last, "host", "left").filter("last_ok IS NULL OR ts >= last_ok").drop("open_from", "last_ok")
    moves = breaker_timeline(needed, threshold, cooldown_seconds)
    return moves.crossJoin(F.broadcast(ends)).filter(F.col("ts_us") >= F.unix_micros("open_from")).drop("open_from")


def write_stream(df: DataFrame, folder: str, output_format: str = "json") -> DataStreamWriter:
    """An append-only file sink with its checkpoint beside it."""
    return (
        df.writeStream.format(output_format)
        .option("checkpointLocation", f"{folder}/_checkpoint")
        .option("path", f"{folder}/rows")
        .outputMode("append")
    )


def write_versions(df: DataFrame, folder: str, mode: str = "update") -> DataStreamWriter:
    """Rows that a stream updates, as versions: a micro-batch owns one folder, so one that runs again replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    return df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/_checkpoint")


def read_versions(spark: SparkSession, folder: str, schema: StructType, keys: list[str], mode: str = "update") -> DataFrame:
    """The newest version of every key. In complete mode the last batch holds all rows, so older keys may be gone."""
    rows = spark.read.schema(StructType(list(schema.fields)).add("version", "long")).parquet(f"{folder}/rows")
    if mode == "complete":
        last = rows.agg(F.max("version").alias("version"))
        return rows.join(F.broadcast(last), "version", "left_semi").drop("version")
    names = [field.name for field in schema.fields]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "version").alias("row"))
    return newest.select("row.*")


def on_events(events: DataFrame, handle: Callable[[DataFrame, int], None], folder: str) -> DataStreamWriter:
    """Calls `handle` with every micro-batch of events and its number; a batch that failed is handed over again."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/_checkpoint")


def write_events_stream(events: DataFrame, folder: str) -> DataStreamWriter:
    """Events and, for finished downloads, manifest lines.

    Every micro-batch owns one folder, so a batch that runs again replaces its own rows.
    """
    names = [field.strip().split(" ")[0] for field in MANIFEST_DDL.split(",")]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{folder}/events/batch={batch_id}")
        # the stored events, so that the batch itself is computed once
        stored = batch.sparkSession.read.schema(batch.schema).json(f"{folder}/events/batch={batch_id}")
        done = stored.filter("event = 'download_complete' AND status = 'ok'")
        manifest = done.withColumns(
            {
                "path": F.concat(F.lit("downloads/"), F.md5("url")),
                "content_type": F.lit(None).cast("string"),
            }
        )
        manifest.select(*names).write.mode("overwrite").json(f"{folder}/manifest/batch={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/_checkpoint")


def run_available(writer: DataStreamWriter) -> None:
    """Process what is there, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
